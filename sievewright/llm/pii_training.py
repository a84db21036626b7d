"""Invented text with labelled spans, and the training of the tagger: python -m sievewright.llm.pii_training OUT.npz

No corpus is read, and no sentence stands here: text is put together from function words of five languages, words of
random syllables, cues that name a kind, and items of random parts. Given names are the frequent ones of the birth
statistics of their countries or random syllables; hosts, families, places and most streets are random.
"""

from __future__ import annotations

import random
import sys
import time
from collections.abc import Callable
from multiprocessing import Pool

import numpy as np

from sievewright.llm.pii_model import KINDS, PAD, Adam, Tagger, encode_text, span_tags

# Frequent given names of English, German, French and Spanish speaking countries, titles, street types.
GIVEN = {
    "en": "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Donald Steven Andrew Paul Joshua Kenneth Kevin Brian George Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Sandra Ashley Emily Donna Michelle Carol Amanda".split(),
    "de": "Peter Michael Thomas Andreas Wolfgang Klaus Jürgen Günter Stefan Christian Uwe Werner Horst Frank Dieter Manfred Gerhard Bernd Torsten Matthias Ursula Maria Monika Petra Elisabeth Sabine Renate Helga Karin Brigitte Ingrid Erika Andrea Gisela Claudia Susanne Gabriele Christa Christine Hildegard".split(),
    "fr": "Jean Pierre Michel André Philippe Alain Bernard Jacques Daniel Gérard Christian Nicolas Patrick Laurent Julien Stéphane François Éric Marie Nathalie Isabelle Sylvie Catherine Françoise Jeanne Monique Christine Nicole Valérie Sandrine Sophie Céline Véronique Anne Chantal Hélène".split(),
    "es": "Antonio José Manuel Francisco David Juan Javier Daniel Carlos Jesús Alejandro Miguel Rafael Pedro Pablo Ángel Sergio Fernando María Carmen Ana Isabel Laura Cristina Marta Dolores Lucía Francisca Antonia Elena Paula Raquel Rosa Pilar Concepción Mercedes".split(),
}
TITLES = {"en": "Mr Mr. Mrs Mrs. Ms Ms. Dr Dr. Prof. Professor Miss".split(), "de": "Herr Frau Dr. Prof.".split(), "fr": "M. Mme Monsieur Madame Mlle Dr".split(), "es": "Sr. Sra. Señor Señora Don Doña Dr. Dra.".split()}
FAMILY_ENDS = "man son sen ton well field ford ley wood berg stein mann bach hoff ier eau ard ont ez es ero ado era ov ski ini er".split()
PLACE_ENDS = "ville burg berg dorf stadt ham ton field ford port mouth sur heim furt ac ay anne illa ona eda ia land".split()
EN_STREET = "Street Road Lane Avenue Close Drive Court Crescent Way Place Terrace Square Gardens Boulevard Row".split()
EN_FIRST = "High Main Park Oak Elm Maple Cedar Pine Hill Lake Washington Victoria Queen's King's First Second Third Fifth North South Spring River View Long".split()
DE_ENDS = "straße str. weg gasse allee platz strasse ring ufer damm".split()
DE_FIRST = "Haupt Bahnhof Garten Schul Dorf Kirch Berg Wald Ring Goethe Schiller Linden Post Friedhof".split()
FR_TYPES = "rue avenue boulevard quai place impasse chemin allée route cours".split()
FR_NAMES = ["de la République", "Victor Hugo", "du Général de Gaulle", "Pasteur", "de la Liberté", "Jean Jaurès", "de l'Église", "des Écoles", "Saint-Michel", "du Port", "des Fleurs"]
ES_TYPES = "Calle Avenida Plaza Paseo Camino Ronda Avda. C/".split()
ES_NAMES = ["Mayor", "Real", "de la Constitución", "de España", "del Sol", "San Juan", "de la Iglesia", "Nueva", "de los Reyes", "del Carmen", "de Andalucía"]
# Function words and plain words of the languages, for the text around items.
WORDS = {
    "en": "the a an and or but of to in on at by for with from is was are were be been has had have it this that these they we you he she his her our their not no yes very more most some any all each both into over after before when where who which while because if then than so only also just now here there again still never always today people time year day way thing world life hand part child eye place week case point number group problem fact water money month book house room friend father power hour game line end member law car city name team minute idea body back parent face level office door health person art war history party result morning reason research moment air teacher force education".split(),
    "de": "der die das und oder aber von zu in auf bei mit für ist war sind waren hat hatte es dieser diese wir sie er ich nicht kein sehr mehr auch nur noch schon immer nie heute wenn weil dann als wie so über unter nach vor zwischen Zeit Jahr Tag Mensch Leben Welt Haus Stadt Land Frage Hand Kind Wasser Geld Woche Monat Buch Raum Freund Arbeit Stunde Ende Gesetz Wagen Name Gruppe Minute Idee Körper Büro Tür Gesundheit Kunst Krieg Geschichte Partei Ergebnis Morgen Grund Moment Luft Lehrer Kraft Bildung großer neuer guter kleiner alter gehen kommen machen sagen sehen geben wissen stehen finden bleiben liegen".split(),
    "fr": "le la les un une des du de et ou mais dans sur avec pour par est était sont avait il elle nous vous ils ce cette ces qui que quand où pas plus très aussi encore toujours jamais aujourd'hui si alors comme après avant entre sous temps année jour homme vie monde maison ville pays question main enfant eau argent semaine mois livre pièce ami travail heure fin loi voiture nom groupe minute idée corps bureau porte santé art guerre histoire parti résultat matin raison moment air force école grand nouveau bon petit vieux aller venir faire dire voir donner savoir prendre trouver rester".split(),
    "es": "el la los las un una unos de del y o pero en con para por es era son había él ella nosotros ellos este esta estos que cuando donde no más muy también aún siempre nunca hoy si entonces como después antes entre bajo tiempo año día hombre vida mundo casa ciudad país pregunta mano niño agua dinero semana mes libro sala amigo trabajo hora fin ley coche nombre grupo minuto idea cuerpo oficina puerta salud arte guerra historia partido resultado mañana razón momento aire fuerza escuela grande nuevo bueno pequeño viejo ir venir hacer decir ver dar saber tomar encontrar quedar".split(),
    "zh": "我们 他们 今天 因为 所以 但是 时间 生活 世界 城市 问题 工作 学校 朋友 先生 以后 之前 请 在 和 的 了 把 从 到 可以 已经 不是 没有 大家 这个 那里 水 书 房子 医生 。 ， 、".split(),
}
# Words that name a kind or stand before one.
CUES: dict[str, dict[str, list[str]]] = {
    "email": {"en": ["email", "e-mail", "mail", "contact", "reply to", "sent from", "address", "Email address", "at"], "de": ["E-Mail", "Mail an", "per Mail", "Kontakt", "von"], "fr": ["courriel", "e-mail", "mél", "contacter", "à"], "es": ["correo", "correo electrónico", "e-mail", "contactar", "a"], "zh": ["邮件", "电子邮箱", "联系"]},
    "phone": {"en": ["phone", "tel", "telephone", "call", "mobile", "fax", "cell", "number", "dial", "on", "at", "Tel."], "de": ["Telefon", "Tel.", "Handy", "Fax", "Rufnummer", "anrufen", "unter"], "fr": ["téléphone", "tél.", "portable", "fax", "appeler", "au"], "es": ["teléfono", "tel.", "móvil", "fax", "llamar", "al"], "zh": ["电话", "手机", "传真", "拨打"]},
    "ipv4": {"en": ["ip", "IP address", "host", "server", "from", "gateway", "ping", "router", "dns", "http://"], "de": ["IP-Adresse", "Server", "Rechner", "von"], "fr": ["adresse IP", "serveur", "hôte", "depuis"], "es": ["dirección IP", "servidor", "equipo", "desde"], "zh": ["服务器", "主机", "来自"]},
    "address": {"en": ["address", "lives at", "at", "office", "ship to", "visit us at", "home", "to"], "de": ["Adresse", "wohnt", "Anschrift", "in der", "Büro", "nach"], "fr": ["adresse", "habite", "au", "siège", "bureau"], "es": ["dirección", "domicilio", "vive en", "oficina", "en"], "zh": ["地址", "住址", "位于"]},
    "name": {"en": ["by", "from", "with", "to", "and", "name", "author", "signed", "contact", "regards", "dear", "said", "thanks to", "met", "director", "manager", ""], "de": ["von", "mit", "an", "und", "Name", "Autor", "gezeichnet", "Kontakt", "Grüße", "laut", "sagte", "dankt", "Leiter", ""], "fr": ["par", "de", "avec", "à", "et", "nom", "auteur", "signé", "contact", "selon", "dit", "merci à", "directeur", ""], "es": ["por", "de", "con", "a", "y", "nombre", "autor", "firmado", "contacto", "según", "dijo", "gracias a", "director", ""], "zh": ["联系人", "作者", "由", "据"]},
}
ID_LABELS = {
    "en": ["SSN", "social security number", "social security no.", "my social", "passport", "passport no.", "passport number", "identity card", "ID card no.", "ID number", "tax ID", "tax number", "National Insurance number", "NI number", "ITIN", "driving licence"],
    "de": ["Reisepass", "Reisepass Nr.", "Personalausweis", "Personalausweis Nr.", "Ausweisnummer", "Steuer-ID", "Steuernummer", "Sozialversicherungsnummer", "Führerschein"],
    "fr": ["passeport", "passeport n°", "carte d'identité", "carte d'identité n°", "numéro de sécurité sociale", "NIR", "numéro fiscal", "permis de conduire"],
    "es": ["pasaporte", "DNI", "NIE", "NIF", "número de la seguridad social", "documento de identidad", "número fiscal"],
    "zh": ["身份证号", "身份证号码", "护照号", "社保号", "税号"],
}
OTHER_LABELS = {
    "en": ["order", "order no.", "part number", "serial", "serial number", "invoice", "ticket", "item", "model", "build", "ISBN", "tracking", "batch", "version", "lot", "ref.", "account page", "room", "catalogue no."],
    "de": ["Bestellung", "Bestellnummer", "Teilenummer", "Seriennummer", "Rechnung", "Artikel", "Modell", "Version", "Charge", "Zimmer", "Seite"],
    "fr": ["commande", "référence", "numéro de série", "facture", "article", "modèle", "version", "lot", "pièce", "page"],
    "es": ["pedido", "referencia", "número de serie", "factura", "artículo", "modelo", "versión", "lote", "pieza", "página"],
    "zh": ["订单号", "零件编号", "序列号", "发票", "型号", "版本", "批次"],
}
# Words that make two capitals a place, an institution or a heading and no name.
PLACE_FRAMES = {
    "en": ["Lake {}", "Mount {}", "Port {}", "New {}", "Old {}", "North {}", "South {}", "Saint {}", "{} University", "{} Institute", "{} Museum", "{} Company", "{} Bridge", "{} River", "{} County", "{} School", "{} Council", "the {} Valley", "{} Castle", "{} Railway", "Fort {}", "Upper {}", "{} Society"],
    "de": ["Bad {}", "Alte {}", "Neuer {}", "Universität {}", "Museum {}", "Stadt {}", "Firma {}", "Landkreis {}", "Burg {}", "{} Brücke", "Alter Markt", "Große Halle"],
    "fr": ["Saint {}", "Mont {}", "Lac {}", "Vieux {}", "Université {}", "Musée {}", "Société {}", "Nouveau {}", "Château {}"],
    "es": ["San {}", "Monte {}", "Lago {}", "Puerto {}", "Universidad {}", "Museo {}", "Nueva {}", "Castillo {}", "Villa {}"],
}
LANGS = ("en", "en", "de", "fr", "es", "zh")
TLDS = "com org net de fr es io info eu co.uk edu gov example test invalid local".split()
Span = tuple[int, int, str]


class Maker:
    """Makes windows of text; `window(size)` gives a text and its spans."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.items: dict[str, Callable[[], str]] = {"email": self.email, "phone": self.phone, "ipv4": self.ipv4, "address": self.address, "name": self.name}

    # --- parts ---

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def syllables(self, low: int = 1, high: int = 3) -> str:
        r = self.r
        one = lambda: r.choice(["b", "c", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "z", "br", "st", "tr", "kl", "ch", "sch", ""]) + r.choice("aeiou") + r.choice(["", "", "", "l", "n", "r", "s", "t", "m", "k"])
        return "".join(one() for _ in range(r.randint(low, high))) or "o"

    def cap(self, low: int = 1, high: int = 3) -> str:
        return self.syllables(low, high).capitalize()

    def family(self) -> str:
        r = self.r
        name = (self.syllables(1, 2) + (r.choice(FAMILY_ENDS) if r.random() < 0.7 else "")).capitalize()
        k = r.random()
        return f"{name}-{self.cap(1, 2)}" if k < 0.06 else f"{r.choice(['O', 'D'])}'{name}" if k < 0.09 else f"{r.choice(['de', 'von', 'van', 'del', 'Mc'])} {name}".replace("Mc ", "Mc") if k < 0.14 else name

    def given(self) -> str:
        r = self.r
        name = r.choice(GIVEN[r.choice(list(GIVEN))]) if r.random() < 0.5 else self.cap(1, 3)
        return f"{name}-{self.cap(1, 2)}" if r.random() < 0.03 else name

    def place(self) -> str:
        return (self.syllables(1, 2) + self.r.choice([*PLACE_ENDS, "", ""])).capitalize()

    # --- items ---

    def name(self) -> str:
        r, g, f = self.r, self.given(), self.family()
        initial = r.choice("ABCDEFGHIJKLMNOPRSTUVW") + "."
        title = r.choice(TITLES[r.choice(list(TITLES))])
        forms = [f"{g} {f}"] * 6 + [f"{g} {initial} {f}", f"{initial} {f}", f"{g[0]}. {f}", f"{initial} {initial} {f}", f"{f}, {g}", f"{f.upper()}, {g}", f"{f.upper()} {g}", f"{g} {f.upper()}", f"{title} {f}", f"{title} {f}", f"{title} {g} {f}", f"{title} {initial} {f}", f"{g} {self.given()} {f}", f"{g} {f} {self.family()}", f"{f}, {initial}"]
        out = r.choice(forms)
        return out.upper() if r.random() < 0.05 else out

    def email(self) -> str:
        r = self.r
        plain = lambda x: "".join(c for c in x.lower() if c.isascii() and c.isalnum()) or "x"
        g, f = plain(self.given()), plain(self.family())
        user = r.choice([f"{g}.{f}", f"{g}_{f}", f"{g[0]}{f}", f"{g}{f}", f"{f}{r.randint(1, 999)}", f"{f}.{g[0]}", f"{g}-{f}", f"{g}+{self.syllables(1, 1)}", g, f"{g}{r.randint(1, 99)}", f"info", f"{self.syllables(1, 2)}.{self.syllables(1, 2)}.{self.syllables(1, 2)}"])
        host = ".".join([*(self.syllables(1, 3) for _ in range(r.choice([1, 1, 1, 2, 3]))), r.choice(TLDS)])
        host = host.replace(".", "-", 1) if host.count(".") > 1 and r.random() < 0.2 else host
        at = r.choice(["@"] * 9 + [" @ ", "＠", " (at) ", " [at] ", " AT ", " at ", "[@]", "(@)", "(at)", "[at]"])
        dot = r.choice([" (dot) ", " [dot] ", " DOT ", " dot ", "[.]", ".", "."]) if at.strip() not in ("@", "＠") else "."
        if at == " at " and dot == ".":
            dot = " dot "
        out = f"{user}{at}{host.replace('.', dot)}"
        return out.upper() if r.random() < 0.08 else out.capitalize() if r.random() < 0.03 else out

    def phone(self) -> str:
        r, d = self.r, self.digits
        sep = r.choice([" ", "-", ".", "", " ", "-"])
        groups = lambda *sizes: sep.join(d(n) for n in sizes)
        area = f"{r.randint(2, 9)}{d(2)}"
        k = r.random()
        if k < 0.38:
            tail = f"{d(3)}{sep or r.choice(['', '-'])}{d(4)}"
            out = r.choice([f"{area}{sep}{tail}", f"{area}{sep}{tail}", f"{area}-{d(3)}-{d(4)}", f"{area} {d(3)} {d(4)}", f"{area}{d(7)}", f"1{area}{d(7)}", f"({area}) {tail}", f"({area}){tail}", f"+1{sep}{area}{sep}{tail}", f"1{sep}{area}{sep}{tail}", f"+1 ({area}) {tail}", f"001 {area} {tail}", f"{d(3)}-{d(4)}"])
        elif k < 0.7:
            country = r.choice(["44", "49", "33", "34", "39", "31", "41", "43", "32", "86", "351", "61", str(r.randint(20, 98))])
            body = r.choice([lambda: groups(2, 4, 4), lambda: groups(3, 3, 3), lambda: groups(1, 2, 2, 2, 2), lambda: groups(4, 6), lambda: groups(2, 7), lambda: d(9), lambda: d(10), lambda: groups(3, 4, 4), lambda: f"{d(2)} {d(5)}-{d(3)}"])()
            out = r.choice([f"+{country}{sep}{body}", f"+{country} (0){body}", f"00{country} {body}", f"+{country} {body}", f"(+{country}) {body}"])
        else:
            body = r.choice([lambda: groups(2, 4, 4), lambda: groups(3, 6), lambda: groups(4, 6), lambda: groups(4, 5), lambda: groups(1, 2, 2, 2, 2), lambda: f"{d(2)}/{d(7)}", lambda: d(9), lambda: d(10), lambda: groups(2, 5, 3)])()
            out = r.choice([f"0{body}", f"0{body}", f"(0{d(3)}) {d(6)}", f"(0{d(2)}) {groups(4, 4)}", f"0{d(4)}/{d(6)}", f"{r.choice('6789')}{groups(2, 3, 3)}", f"{r.choice('69')}{groups(2, 2, 2, 2)}", f"1{d(2)}{sep}{d(4)}{sep}{d(4)}", f"0{r.randint(1, 9)}{sep or ' '}{groups(2, 2, 2, 2)}"])
        if r.random() < 0.08:
            out += r.choice([" ext. ", " x", " ext ", " Durchwahl ", " poste ", " int. "]) + str(r.randint(1, 999))
        return out.translate({ord(str(i)): 0xFF10 + i for i in range(10)}) if r.random() < 0.05 else out

    def ipv4(self) -> str:
        r = self.r
        part = lambda: str(r.randint(0, 255)) if r.random() < 0.8 else str(r.randint(0, 9))
        parts = [part() for _ in range(4)]
        if r.random() < 0.4:
            parts[:2] = r.choice([["192", "168"], ["10", part()], ["172", str(r.randint(16, 31))], ["127", "0"]])
        return r.choice(["."] * 8 + ["[.]", " . ", "(.)", "。", "．", " [.] "]).join(parts)

    def street(self) -> str:
        r, lang = self.r, self.r.choice(["en", "en", "de", "fr", "es"])
        n = str(r.randint(1, 99) if r.random() < 0.6 else r.randint(100, 2500))
        if lang == "en":
            first = r.choice(EN_FIRST) if r.random() < 0.4 else " ".join(self.cap(1, 2) for _ in range(r.choice([1, 1, 2])))
            out = f"{n}{r.choice(['', '', '', 'A', 'b'])} {first} {r.choice(EN_STREET)}"
            return r.choice([out, out, out, f"Flat {r.randint(1, 60)}, {out}", f"{out}, Apt {r.randint(1, 60)}", f"Unit {r.randint(1, 60)}, {out}"])
        if lang == "de":
            first = r.choice(DE_FIRST) if r.random() < 0.4 else self.cap(1, 3)
            out = r.choice([f"{first}{r.choice(DE_ENDS)}", f"{first}{r.choice(DE_ENDS)}", f"{first}{r.choice(DE_ENDS)}", f"{self.cap(1, 2)}er {r.choice(['Straße', 'Weg', 'Allee', 'Platz'])}", f"Am {self.cap(1, 3)}", f"An der {self.cap(1, 2)}", f"Auf dem {self.cap(1, 2)}", f"Am Alten {self.cap(1, 2)}"])
            return f"{out} {n}{r.choice(['', '', '', 'a', ' b', ', 3. Stock'])}"
        if lang == "fr":
            name = r.choice(FR_NAMES) if r.random() < 0.4 else r.choice(["de ", "du ", "des ", "de la ", "de l'", ""]) + " ".join(self.cap(1, 3) for _ in range(r.choice([1, 1, 2])))
            return f"{n}{r.choice(['', '', '', ' bis', ' ter', 'B'])}{r.choice([' ', ' ', ', '])}{r.choice(FR_TYPES)} {name}"
        name = r.choice(ES_NAMES) if r.random() < 0.4 else r.choice(["de ", "del ", "de la ", "de los ", "", ""]) + " ".join(self.cap(1, 3) for _ in range(r.choice([1, 1, 2])))
        return f"{r.choice(ES_TYPES)} {name}{r.choice([' ', ', ', ', n.º ', ' nº ', ', núm. '])}{n}{r.choice(['', '', '', ', 2.º B', ', 1.º A'])}"

    def address(self) -> str:
        r, out = self.r, self.street()
        if r.random() < 0.45:
            code = r.choice([self.digits(5), self.digits(5), self.digits(4), f"{self.cap(1, 1)[:1]}W{r.randint(1, 9)} {r.randint(1, 9)}AB"])
            out += r.choice([f", {code} {self.place()}", f", {self.place()} {code}", f", {self.place()}", f",\n{self.place()} {code}", f" {code} {self.place()}"])
        k = r.random()
        return out.lower() if k < 0.07 else out.upper() if k < 0.14 else out

    def id_value(self) -> str:
        r, d = self.r, self.digits
        letters = lambda n: "".join(r.choice("ABCDEFGHJKLMNPRSTVWXYZ") for _ in range(n))
        return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9), d(8), d(11), d(10), d(12), d(15), f"{d(8)}{letters(1)}", f"{letters(1)}{d(7)}{letters(1)}", f"{letters(1)}{d(8)}", f"{letters(2)}{d(7)}", f"{letters(2)} {d(2)} {d(2)} {d(2)} {letters(1)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{d(17)}X", d(18), f"{letters(1)}{letters(1)}{d(2)}{letters(1)}{d(4)}", f"{d(2)}/{d(3)}/{d(5)}"])

    # --- text around items ---

    def number(self) -> str:
        r, d = self.r, self.digits
        return r.choice([
            lambda: str(r.randint(1, 9)), lambda: str(r.randint(10, 999)), lambda: str(r.randint(1500, 2030)), lambda: f"{r.randint(0, 999)}.{d(r.randint(1, 4))}", lambda: f"{r.randint(1, 99)},{d(3)}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}", lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1900, 2030)}",
            lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(0, 23):02d}:{d(2)}", lambda: f"{r.randint(0, 23):02d}:{d(2)}:{d(2)}", lambda: f"{r.randint(1, 99)}%", lambda: f"{r.randint(1, 400)}-{r.randint(1, 999)}", lambda: f"{r.choice('$€£')}{r.randint(1, 9999)}", lambda: f"v{r.randint(0, 20)}.{r.randint(0, 30)}.{r.randint(0, 99)}",
            lambda: f"{r.randint(1, 99)}.{r.randint(256, 999)}.{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: "-".join(d(4) for _ in range(r.randint(3, 4))), lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"{r.randint(1, 99)} @ {r.randint(1, 99)}", lambda: f"#{r.randint(1, 999)}", lambda: f"{r.randint(1, 99)} x {r.randint(1, 99)}", lambda: f"{r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}.",
        ])()

    def words(self, lang: str, n: int) -> str:
        r, out = self.r, []
        for _ in range(n):
            k = r.random()
            if k < 0.62:
                out.append(r.choice(WORDS[lang]))
            elif k < 0.76:
                out.append(self.syllables(1, 4) if lang != "de" or r.random() < 0.5 else self.cap(1, 4))
            elif k < 0.84:
                out.append(self.number())
            elif k < 0.88:
                out.append(self.place())
            elif k < 0.91:
                out.append(r.choice(GIVEN[r.choice(list(GIVEN))]) if r.random() < 0.5 else self.cap(1, 2))
            elif k < 0.94 and lang != "zh":
                out.append(r.choice(PLACE_FRAMES[lang]).format(self.place()))
            elif k < 0.95 and lang != "zh":
                out.append(self.bare_street(lang))
            elif k < 0.955:
                out.append(f"@{self.syllables(1, 3)}")
            else:
                out.append(r.choice(WORDS[lang]) + r.choice([",", ",", ";", ":", " -", "."]))
            if len(out) > 1 and out[-1][:1].isupper() and out[-2][:1].isupper() and out[-2][-1:].isalpha():
                out.insert(-1, r.choice([w for w in WORDS[lang] if w.islower() or lang == "zh"]))  # two capitals in a row are mostly a name
        text = ("" if lang == "zh" and r.random() < 0.8 else " ").join(out)
        return text[:1].upper() + text[1:] if r.random() < 0.7 else text

    def bare_street(self, lang: str) -> str:
        """A street without a number, which is no item."""
        r = self.r
        return {"en": lambda: f"{r.choice(EN_FIRST) if r.random() < 0.5 else self.cap(1, 2)} {r.choice(EN_STREET)}", "de": lambda: f"{self.cap(1, 2)}{r.choice(DE_ENDS)}", "fr": lambda: f"{r.choice(FR_TYPES)} {r.choice(FR_NAMES)}", "es": lambda: f"{r.choice(ES_TYPES)} {r.choice(ES_NAMES)}"}[lang]()

    def joined(self, parts: list[tuple[str, str | None]], lang: str) -> tuple[str, list[Span]]:
        text, spans = "", []
        for value, kind in parts:
            gap = "" if not text or not value or text[-1] in "\n(<\"'" or (lang == "zh" and self.r.random() < 0.6) or value[0] in ".,;:!?)>" else " "
            text += gap
            if kind:
                spans.append((len(text), len(text) + len(value), kind))
            text += value
        return text, spans

    def sentence(self) -> tuple[str, list[Span]]:
        """Words, maybe one or two items with a cue, and an end."""
        r, lang = self.r, self.r.choice(LANGS)
        k = r.random()
        if k < 0.06:
            return self.table(), []
        if k < 0.15:
            return self.row()
        if k < 0.17:
            return self.heading(lang), []
        if k < 0.42:
            return self.cased(self.words(lang, r.randint(2, 14)) + r.choice([".", ".", "!", "?", ""]), [])
        parts: list[tuple[str, str | None]] = []
        if r.random() < 0.6:
            parts.append((self.words(lang, r.randint(1, 7)), None))
        kind = r.choice([*KINDS, "name", "name", "address", "other"])
        if kind in ("id_number", "other"):
            label = r.choice((ID_LABELS if kind == "id_number" else OTHER_LABELS)[lang]) + r.choice(["", "", ":", ":", " :", " =", " #", " is", ","])
            parts.append((label, None))
            value = self.id_value() if kind == "id_number" or r.random() < 0.6 else self.number()
            parts.append((value, kind if kind == "id_number" else None))
        else:
            cue = r.choice(CUES[kind][lang])
            if r.random() < 0.8 and cue:
                parts.append(((cue.capitalize() if r.random() < 0.4 else cue) + r.choice(["", "", "", ":", ":", " :", ","]), None))
            wrap = r.choice([("", "")] * 12 + [("(", ")"), ("<", ">"), ('"', '"'), ("<mailto:", ">") if kind == "email" else ("[", "]")])
            value = self.items[kind]()
            tail = r.choice([":8080", "/24", ":22", "/status"]) if kind == "ipv4" and r.random() < 0.12 else ""
            if wrap[0]:
                parts.append((wrap[0], None))
                text, spans = self.joined(parts, lang)
                spans.append((len(text), len(text) + len(value), kind))
                return self.cased(text + value + tail + wrap[1] + " " + self.words(lang, r.randint(0, 4)), spans)
            parts.append((value, kind))
            if tail:
                parts[-1] = (value, kind)
                text, spans = self.joined(parts, lang)
                return self.cased(text + tail + ".", spans)
        parts.append((r.choice([".", ".", ",", ";", "", "", ")", "!"]), None))
        if r.random() < 0.6:
            parts.append((self.words(lang, r.randint(1, 6)), None))
            parts.append((r.choice([".", ".", "!", "?", ""]), None))
        return self.cased(*self.joined(parts, lang))

    def heading(self, lang: str) -> str:
        r = self.r
        return " ".join((r.choice(WORDS[lang]) if r.random() < 0.7 else self.syllables(1, 3)).title() for _ in range(r.randint(2, 6))) + r.choice(["\n", "\n", ":", " | "])

    def table(self) -> str:
        """A row of numbers, words and places, or a line of a log or a dump of digits."""
        r, lang = self.r, self.r.choice(LANGS[:5])
        if r.random() < 0.3:
            return r.choice([" ", "\n", ", ", "  "]).join(r.choice([self.digits(r.randint(1, 6)), f"0.{self.digits(3)}", self.number()]) for _ in range(r.randint(6, 24))) + "\n"
        cell = lambda: r.choice([self.number(), self.number(), self.digits(r.randint(1, 7)), "n/a", "-", "yes", "", self.place(), self.words(lang, r.randint(1, 3)), f"{self.syllables(1, 2)}={self.number()}"])
        return r.choice(["\t", ",", " | ", ";", "   ", " "]).join(cell() for _ in range(r.randint(3, 8))) + "\n"

    def row(self) -> tuple[str, list[Span]]:
        """A line of a contact list, or a list of items of one kind."""
        r = self.r
        sep = r.choice(["\t", ";", " | ", ", ", "; ", "\n", " / "])
        kinds = [r.choice(["phone", "email", "ipv4", "name"])] * r.randint(2, 6) if r.random() < 0.35 else r.sample(list(self.items), r.randint(2, 4))
        text, spans = "", []
        for i, kind in enumerate(kinds):
            text += sep if i else ""
            item = r.random() < 0.8
            value = self.items[kind]() if item else self.words("en", r.randint(1, 3))
            if item:
                spans.append((len(text), len(text) + len(value), kind))
            text += value
        return text + "\n", spans

    def cased(self, text: str, spans: list[Span]) -> tuple[str, list[Span]]:
        k = self.r.random()
        lowered, raised = text.lower(), text.upper()
        if k < 0.04 and len(lowered) == len(text):
            return lowered, [s for s in spans if s[2] != "name"]
        if k < 0.08 and len(raised) == len(text):
            return raised, spans
        return text, spans

    def window(self, size: int) -> tuple[str, list[Span]]:
        text, spans, skip = "", [], self.r.randint(0, 60)
        while len(text) < skip + size:
            more, found = self.sentence()
            spans += [(a + len(text), b + len(text), k) for a, b, k in found]
            text += more + self.r.choice([" ", " ", " ", " ", "\n", "\n\n", "", "  "])
        # what a window shows of an item cut by its left edge is outside: another window has the item's beginning
        cut = [(a - skip, min(b, skip + size) - skip, k) for a, b, k in spans if a >= skip and a < skip + size]
        return text[skip : skip + size], cut


def batch(maker: Maker, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.full((rows, size), PAD, dtype=np.int16), np.zeros((rows, size), dtype=np.int8)
    for i in range(rows):
        text, spans = maker.window(size)
        x[i, : len(text)] = encode_text(text)
        y[i, : len(text)] = span_tags(len(text), spans)
    return x.T, y.T


_MAKERS: dict[int, Maker] = {}


def _gradients(task: tuple[int, int, int, Tagger]) -> tuple[float, dict[str, np.ndarray]]:
    seed, rows, size, model = task
    return model.loss(*batch(_MAKERS.setdefault(seed, Maker(seed)), rows, size))


def train(out: str, seconds: float = 900, start: str | None = None, hidden: int = 24, rows: int = 32, size: int = 112, seed: int = 5, workers: int = 8, rate: float = 0.01) -> None:
    """Trains for `seconds` on fresh windows, from the weights `start` if given; each worker process gives the gradients
    of `rows` of them a step."""
    model = Tagger.load(start) if start else Tagger(hidden)
    adam, began, i = Adam(model.p, rate), time.time(), 0
    with Pool(workers) as pool:
        while (spent := time.time() - began) < seconds:
            adam.rate = rate * max(0.02, 1 - spent / seconds) * min(1.0, (i + 1) / 50)
            found = pool.map(_gradients, [(seed * 100 + w, rows, size, model) for w in range(workers)], chunksize=1)
            adam.step(model.p, {k: np.mean([g[k] for _, g in found], axis=0) for k in model.p})
            if i % 50 == 0:
                print(i, round(spent), round(float(np.mean([v for v, _ in found])), 5), flush=True)
                model.save(out)
            i += 1
    model.save(out)
    x, y = batch(Maker(seed + 1), 1500, size)
    print(report(model.decode(x), y))


def report(found: np.ndarray, gold: np.ndarray) -> dict[str, tuple[float, float]]:
    """By kind (recall, precision) of characters."""
    out = {}
    for k, kind in enumerate(KINDS):
        f, g = (found + 1) // 2 == k + 1, (gold + 1) // 2 == k + 1
        out[kind] = (round(float((f & g).sum() / max(1, g.sum())), 4), round(float((f & g).sum() / max(1, f.sum())), 4))
    return out


if __name__ == "__main__":
    train(sys.argv[1], float(sys.argv[2]) if len(sys.argv) > 2 else 900, sys.argv[3] if len(sys.argv) > 3 else None)
