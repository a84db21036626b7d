"""Problem 4: personal information in free text, found by the tagger of pii_model and replaced by placeholders.

All of every text is cut into overlapping windows. Where windows overlap, the tags of the window whose edge is farther
away count, over the whole text. Each span is widened to whole words and passes an exact check of its kind. Where these
checks refuse whatever the tagger could say (`reach`), its windows are not run; the spans are those of a run of them all.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions.units import code_points
from sievewright.llm.arrow import column, map_batches, values
from sievewright.llm.pii_model import KINDS, PAD, Tagger, symbol_table
from sievewright.llm.pii_training import GIVEN as GIVEN_NAMES

WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")
GIVEN = frozenset(name for names in GIVEN_NAMES.values() for name in names)
PLACEHOLDERS = {"email": "|||EMAIL_ADDRESS|||", "phone": "|||PHONE_NUMBER|||", "ipv4": "|||IP_ADDRESS|||", "id_number": "|||ID_NUMBER|||", "address": "|||STREET_ADDRESS|||", "name": "|||PERSON_NAME|||"}
WINDOW, OVERLAP = 112, 32
ROWS = 2048
#: Added to the score of a first character of each kind: the exact checks behind the tagger make up for its false starts.
BIAS = {"email": 2.0, "phone": 3.5, "ipv4": 2.0, "id_number": 4.0, "address": 3.5, "name": 2.5}
BLOCK_CHARS = 1 << 18

# Words that open a sentence or a place and no name, and words that name a person's number.
NOT_GIVEN = frozenset(
    "two three four five six seven eight zwei drei vier fünf sechs sieben acht dos tres deux trois als quand cuando as until bis hasta jusqu dit dijo fragte sagte asked said "
    "the a an in on at of for from with by to and but or nor so if when while after before during between under without near this that these those then next first second finally use do about according nobody lake mount port saint old new north south east west room page order build firmware version server mirror finally "
    "der die das den dem des ein eine einen einem einer eines im am an auf bei beim nach vor seit mit ohne zum zur und oder aber wenn wie was wo laut rund etwa zuerst danach dann bad jeden jede jener hinter kurz bald gegen zwischen während niemand "
    "le la les l un une des du de d au aux en dans sur sous avec sans pour par et ou mais si puis après avant selon environ un vers sur le "
    "el la los las un una unos unas del de al en con sin por para y o pero si según cerca antes después durante".split()
)
PLACE_WORDS = frozenset("lake mount port saint bad institute museum university school company church road street lane avenue drive close court crescent way place terrace square gardens hill river bridge mill station hall house college library society north south east west upper lower old new council county valley st".split())
ARTICLES = frozenset("the a an der die das den dem des ein eine einen einem einer le la les un une el los las una two three seven zwei drei sieben deux trois dos tres his her their mein sein".split())
ARTICLE_ENDS = tuple(ARTICLES)
TITLES = frozenset("mr mrs ms dr prof professor miss herr frau m mme monsieur madame mlle sr sra señor señora don doña sir dame".split())
ID_LABEL = re.compile(
    r"(?i:ssn|social|passport|identity|identidad|\bid card|\btax|national insurance|\bnino\b|\bitin\b|reisepass|ausweis|steuer|versicherung|passeport|identité|sécurité|fiscal|pasaporte|\bdni\b|\bnif\b|seguridad|身份证|护照|证件|社保|税号|licen[cs]e|führerschein|\bid-?nr|\bid (?:no|number)\b|identifikation)|\b(?:NIE|NIR|NI)\b"
)
SIGNED = re.compile(r"(?i)(?:signed|firmado|signé|gezeichnet|contact|contacto|kontakt|ansprechpartner|regards|laut|selon|según)\s?[,:]?\s")
AT = r"(?:@|\(\s*at\s*\)|\[\s*at\s*\]|\[\s*@\s*\]|\(\s*@\s*\)|\sat\s)"
DOT = r"(?:\.|\s?\(\s*dot\s*\)\s?|\s?\[\s*dot\s*\]\s?|\[\s*\.\s*\]|\sdot\s)"
EMAIL = re.compile(rf"(?i)[a-z0-9._%+\-]*[a-z0-9_%+\-]\s?{AT}\s?[a-z0-9\-]+(?:{DOT}[a-z0-9\-]+)*{DOT}[a-z]{{2,}}")
PREVIOUS = re.compile(r"([^\W\d_]+)\s+$")
IPV4 = re.compile(r"\d{1,3}(?:\s?[\[(]?\s?[.。．]\s?[\])]?\s?\d{1,3}){3}")
NUMBER = re.compile(r"(?<![\w.])[+(]?\d(?:[ ().\-/–]{0,3}\d)+")
EXTENSION = re.compile(r"(?i)\s*[,;]?\s*(?:ext\.?|extension|x|durchwahl|poste|apdo|int\.?)\s*")
_CAP = r"[A-ZÀ-ÞŒ][\w'’.\-]*"
_EN = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Close|Drive|Court|Crescent|Way|Place|Terrace|Square|Gardens|Row|Grove|Mews|Walk|Hill)\b"
_FR = r"(?:rue|quai|boulevard|bd|impasse|chemin|avenue|place|allée|route|cours|square|passage)\b"
_ES = r"(?:calle|c/|avenida|avda\.?|plaza|paseo|camino|ronda|travesía|carretera)"
#: A house number beside a street name, as English, French, Spanish and German write them; in one case or with capitals.
ADDRESS = re.compile(
    rf"(?:(?i:flat|apt|unit)\s\d{{1,4}},?\s)?\b\d{{1,4}}\s?[A-Za-z]?,?\s(?:{_CAP}\s){{1,3}}(?:{_EN}|(?i:{_EN}))|\b\d{{1,4}}[a-z]?,?\s(?:[a-zà-ÿ'’]+\s){{1,2}}(?:street|road|lane|avenue|close|drive|court|crescent|way|terrace|square|gardens|hill road)\b"
    rf"|\b\d{{1,4}}(?:\s?(?i:bis|ter|quater|[a-d]))?,?\s(?i:{_FR})\s(?i:d[eu]s?\s|de\sla\s|de\sl['’]|du\s|d['’])?[\w'’\-]+"
    rf"|(?i:\b{_ES})\s[^\d\n;|\t]{{2,40}}?,?\s?(?i:n\.?\s?[º°o]\.?\s?|núm\.?\s?|#)?\d{{1,4}}\b"
    rf"|\b[A-ZÀ-Þa-zà-ÿ][\w\-]*(?i:straße|strasse|str\.|weg|gasse|allee|platz|ufer|damm|ring|markt|steig)\s\d{{1,4}}\s?[a-z]?\b"
    rf"|\b(?i:am|an\sder|auf\sdem|auf\sder)\s(?:{_CAP}\s){{1,3}}\d{{1,4}}\s?[a-z]?\b"
)
# Parts of these patterns which each of their matches has, also one that ends where a search ends: no border follows.
_OPEN = _EN.removesuffix(r"\b")
HOUSE_FIRST = re.compile(
    rf"\d{{1,4}}\s?[A-Za-z]?,?\s(?:{_CAP}\s){{1,3}}(?i:{_OPEN})|\d{{1,4}}[a-z]?,?\s(?:[a-zà-ÿ'’]+\s){{1,2}}(?:street|road|lane|avenue|close|drive|court|crescent|way|terrace|square|gardens|hill road)"
    rf"|\d{{1,4}}(?:\s?(?i:bis|ter|quater|[a-d]))?,?\s(?i:{_FR})\s"
)
STREET_FIRST = re.compile(rf"(?i:{_ES})\s[^\d\n;|\t]{{2,40}}?,?\s?(?i:n\.?\s?[º°o]\.?\s?|núm\.?\s?|#)?\d")
STREET_ENDS = ("strasse", "str.", "weg", "gasse", "allee", "platz", "ufer", "damm", "ring", "markt", "steig")
LABEL_START = re.compile(
    r"(?i)ssn|social|passport|identity|identidad|\bid card|\btax|national insurance|\bnino|\bitin|reisepass|ausweis|steuer|versicherung|passeport|identité|sécurité|fiscal|pasaporte|\bdni|\bnif|seguridad|身份证|护照|证件|社保|税号|licen[cs]e|führerschein|\bid-?nr|\bid (?:no|number)|identifikation"
)
#: The first three characters of these labels and of the Spanish street words; labels of two characters stand apart.
LABEL_HEADS = ("ssn", "soc", "pas", "ide", "id ", "id-", "idn", "tax", "nat", "nin", "iti", "rei", "aus", "ste", "ver", "séc", "fis", "dni", "nif", "seg", "lic", "füh")
STREET_HEADS = ("cal", "c/ ", "ave", "avd", "pla", "pas", "cam", "ron", "tra", "car")
LABEL_SIGNS = "身护证社税"
SPELT_AT = re.compile(rf"(?i)at(?:\s*[\])]|\s)\s?[a-z0-9\-]+(?:{DOT}[a-z0-9\-]+)*{DOT}[a-z]{{2,}}")
#: The end of one sentence and the start of the next, which no address holds.
SENTENCES = re.compile(r"[^\W\d_]{5,}[.!?]\s+[^\W\d_]")


@lru_cache(maxsize=1)
def tagger() -> Tagger:
    return Tagger.load(WEIGHTS)


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 character of overlapping windows over all of each text of a block; the texts begin at `bounds`,
    with one character between them. Every character is in a window."""
    begin, last = bounds[:-1], bounds[1:] - 1
    begin, last = begin[last > begin], last[last > begin]
    step = WINDOW - OVERLAP
    n = np.maximum(1, -(-(last - begin - OVERLAP) // step))
    group = np.repeat(np.arange(len(begin)), n)
    k = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
    start = begin[group] + k * step
    return start, np.minimum(start + WINDOW, last[group])


def tag(points: np.ndarray, start: np.ndarray, end: np.ndarray, bias: dict[str, float] = BIAS, out: np.ndarray | None = None, chosen: np.ndarray | None = None) -> np.ndarray:
    """Tags of a block's characters; outside the windows 0. With `chosen`, only these windows are run, and `out`, the tags
    of others, is filled up: each window gives the tags of its own characters."""
    symbols = symbol_table()[points]
    out = np.zeros(len(points), dtype=np.int8) if out is None else out
    model, starts = tagger(), np.array([bias[k] for k in KINDS], dtype=np.float32)
    chosen = np.arange(len(start)) if chosen is None else chosen
    first, last = own(start, end)
    size = end - start
    for least, width in ((0, 64), (64, WINDOW)):
        some = chosen[(size[chosen] <= width) & (size[chosen] > least)]
        some = some[np.argsort(-size[some], kind="stable")]
        for part in (some[i : i + ROWS] for i in range(0, len(some), ROWS)):
            at = start[part][:, None] + np.arange(width)
            x = np.where(at < end[part][:, None], symbols[np.minimum(at, len(points) - 1)], PAD)
            tags = model.decode(np.ascontiguousarray(x.T), starts).T
            mine = (at >= first[part][:, None]) & (at < last[part][:, None])
            out[at[mine]] = tags[mine]
    return out


def own(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 character of each window that is farther from its edges than from those of its neighbours."""
    meet = start[1:] < end[:-1]  # windows of different texts have a character between them
    first, last = start.copy(), end.copy()
    first[1:][meet] += OVERLAP // 2
    last[:-1][meet] = first[1:][meet]
    return first, last


# What a character is to the check of names, by what it folds to, and bits for those of numbers.
GAP, LOWER, UPPER, FOREIGN, WIDE, DIGIT, BORDER, WILD, ODD, JOIN = range(10)
STOP, DOTTED, POINT, DECIMAL, ALNUM, SIGN = 1, 2, 4, 8, 16, 32


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: class, bits, number of digits, and the one character it folds to (a space if it folds to more)."""
    classes, bits, digits = (np.zeros(0x110000, dtype=np.uint8) for _ in range(3))
    folds = np.arange(0x110000, dtype=np.uint32)
    for code in (*range(0x33480), *range(0xE0000, 0xE0200)):
        char = chr(code)
        folded = unicodedata.normalize("NFKC", char)
        if len(folded) != 1 or folded != char:
            folds[code] = ord(folded) if len(folded) == 1 else 32
        words = [c for c in folded if c.isalnum() and not c.isdecimal()]
        digits[code] = sum(c.isdigit() for c in folded)
        bits[code] = (
            STOP * bool(words or char in "\t\n" or "," in folded)
            + DOTTED * all(c.isdecimal() or c.isspace() or c in "()[].．。" for c in folded)
            + POINT * any(c in ".．。" for c in folded)
            + DECIMAL * char.isdecimal()
            + ALNUM * char.isalnum()
            + SIGN * (char in LABEL_SIGNS)
        )
        if char.isalnum():
            if digits[code]:
                kind = DIGIT
            elif len(words) < len(folded) or not folded:
                kind = ODD
            elif any(c.isalpha() and not c.isascii() and "LATIN" not in unicodedata.name(c, "") for c in words):
                kind = FOREIGN
            else:
                kind = WIDE if char >= "⺀" else UPPER if folded[0].isupper() else LOWER
        elif char in "\t\n;|":
            kind = BORDER
        elif any(c.isalnum() or unicodedata.category(c)[0] == "M" for c in folded):
            kind = WILD
        else:
            kind = JOIN if folded in ("'", "’", "-") else GAP
        classes[code] = kind
    return classes, bits, digits, folds


@lru_cache(maxsize=1)
def _head_tables() -> tuple[np.ndarray, np.ndarray]:
    """Five bits of every code point, the same in upper and lower case, and by 15 bits of three characters whether they may
    open a label (1) or a Spanish street (2)."""
    five = (np.arange(0x110000) & 31).astype(np.uint16)
    five[[code for code in range(0x3001) if chr(code).isspace()]] = 0
    five[[0x17F, 0x130, 0x131, 0x212A]] = [ord(c) & 31 for c in "siik"]
    opens = np.zeros(1 << 15, dtype=np.uint8)
    for what, heads in ((1, LABEL_HEADS), (2, STREET_HEADS)):
        for head in heads:
            a, b, c = five[[ord(x) for x in head]].tolist()
            opens[a << 10 | b << 5 | c] |= what
    return five, opens


def _plain(text: str) -> str:
    return text.lower() if text.isascii() else text.casefold().replace("ı", "i").replace("i̇", "i")


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def _name_gaps(text: str, points: np.ndarray, bounds: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Characters of which every name that passes has one: those behind the first of two words that may open a name."""
    letter = (kinds >= LOWER) & (kinds <= WIDE)
    wide, cjk = kinds == WIDE, letter & (points >= 0x2E80)
    change = letter[1:] != letter[:-1]
    if cjk.any():  # a name may begin or end beside such a letter
        change |= (cjk[1:] != cjk[:-1]) | (wide[1:] != wide[:-1])
    edge = np.concatenate(([0], np.flatnonzero(change) + 1, [len(points)]))
    is_word = letter[edge[:-1]]
    start, end = edge[:-1][is_word], edge[1:][is_word]
    if len(start) < 2:
        return start[:0]
    others = np.concatenate(([0], np.cumsum(kinds == FOREIGN, dtype=np.int32)))
    foreign, wide = others[end] > others[start], wide[start]
    upper, short = kinds[start] == UPPER, end - start <= 2
    joined = (start[1:] - end[:-1] == 1) & (kinds[end[:-1]] == JOIN)
    touch = start[1:] == end[:-1]
    before, after = np.concatenate(([False], joined | touch)), np.concatenate((joined | touch, [False]))
    second = ~foreign & (upper | short | wide)
    # a name may begin with any part of a word that has parts
    chain = np.cumsum(~before) - 1
    tall = upper | wide
    earlier = np.bincount(chain, tall)[chain] > tall
    lead = ~foreign & (tall | short | earlier)
    blocked = np.concatenate(([0], np.cumsum((kinds == DIGIT) | (kinds == BORDER), dtype=np.int32)))
    clear = blocked[start[1:]] == blocked[end[:-1]]
    pair = np.flatnonzero(lead[:-1] & second[1:] & ~joined & ~touch & clear)
    whole = (~(earlier | wide | np.concatenate(([False], touch)))[pair]).tolist()
    whole_next = (~(after | wide)[pair + 1]).tolist()
    lows = bounds[np.searchsorted(bounds, start[pair], side="right") - 1].tolist()
    keep = []
    for a, b, c, d, w, v, low in zip(start[pair].tolist(), end[pair].tolist(), start[pair + 1].tolist(), end[pair + 1].tolist(), whole, whole_next, lows):
        word, follower = text[a:b], text[c:d]
        if w:
            folded = (word if word.isascii() else unicodedata.normalize("NFKC", word)).lower()
            if (len(folded) > 1 and folded in NOT_GIVEN) or folded in PLACE_WORDS:
                continue
            if len(folded) == 1 and folded != "m" and not _initial(text, b):
                continue
            if folded not in TITLES and text[max(low, a - 14) : a].rstrip().lower().endswith(ARTICLE_ENDS) and (m := PREVIOUS.search(text, max(low, a - 14), a)) and m[1].lower() in ARTICLES:
                continue
        if v and (follower if follower.isascii() else unicodedata.normalize("NFKC", follower)).lower() in PLACE_WORDS:
            continue
        keep.append(b)
    return np.array(keep, dtype=np.int64)


def _initial(text: str, at: int) -> bool:
    """Whether a full stop follows here, as after an initial."""
    return bool(re.match(r"\s?\.", unicodedata.normalize("NFKC", text[at : at + 3])))


def _street_before(text: str, at: int) -> int | None:
    """No later than where a street name begins that ends before the house number here, `at` if none does, or None if the
    words before are too long to say."""
    low, street = max(0, at - 160), at
    if _plain(text[max(0, at - 8) : at - 1]).endswith(STREET_ENDS):
        street = at - 1
        while street and (text[street - 1].isalnum() or text[street - 1] in "_-."):
            street -= 1
    words = text[low:at].rsplit(None, 4)
    for i in range(len(words) - 1, -1, -1):
        if i < len(words) - 1 and _plain(words[i]).endswith(("am", "der", "dem")):
            return min(low - 5, street)
        if not i and low:
            return None if re.fullmatch(r"[\w'’.\-]*", words[i]) else street
        if i < len(words) - 3 or not ("A" <= words[i][0] <= "Z" or "À" <= words[i][0] <= "Þ" or words[i][0] == "Œ"):
            return street
    return street


def reach(text: str, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bits (1 << kind) of every character of a block of texts. A tagged span that passes its exact check, or that of
    another number where `resolved` changes its kind, has a character with the bit of its kind, wherever it begins and ends.

    The bits follow from the checks alone and are many more than the items. Words are widened by the checks, so what lies
    in letters and digits without a gap is marked with them.
    """
    classes, bits, digits, folds = _tables()
    marks = np.zeros(len(points), dtype=np.uint8)
    bit = {k: 1 << i for i, k in enumerate(KINDS)}
    number = bit["phone"] | bit["ipv4"] | bit["id_number"]
    kinds, flags = classes[points], bits[points]
    solid = np.flatnonzero((flags & ALNUM) == 0)

    def mark(first, last, what: int) -> None:
        first, last = np.maximum(np.atleast_1d(first), 0), np.minimum(np.atleast_1d(last), len(points))
        if len(first):
            left = np.concatenate(([-1], solid))[np.searchsorted(solid, first)] + 1
            right = np.concatenate((solid, [len(points)]))[np.searchsorted(solid, last - 1)]
            for a, b in zip(np.minimum(left, first).tolist(), np.maximum(right, last).tolist()):
                marks[a:b] |= what

    # names: see _name_gaps; marks and symbols that fold to letters lie inside a span or outside it, but not in its words
    marks[_name_gaps(text, points, bounds, kinds)] |= bit["name"]
    marks[kinds == WILD] |= bit["name"]
    for at in np.flatnonzero(points == ord("_")).tolist():
        if _initial(text, at + 1):
            marks[at] |= bit["name"]

    # e-mail addresses: no farther from the sign than their check looks
    folded = folds[points]
    signs = [np.flatnonzero(folded == ord("@"))]
    small = folded | 32
    spelt = np.flatnonzero((small[:-1] == ord("a")) & (small[1:] == ord("t")))
    spelt = spelt[((bits[folded[spelt - 1]] & ALNUM) == 0) & ((bits[folded[np.minimum(spelt + 2, len(points) - 1)]] & ALNUM) == 0)]
    if len(spelt):
        plain = text if text.isascii() else folded.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        signs.append(np.array([p for p in spelt.tolist() if SPELT_AT.match(plain, p)], dtype=np.int64))
    signs = np.concatenate(signs)
    mark(signs - 40, signs + 31, bit["email"])

    count = digits[points]
    at = np.flatnonzero(count > 0)
    if len(at):
        # telephone numbers: seven digits without a letter or comma between; network addresses: four with three points
        for stops, least, dots in ((np.flatnonzero(flags & STOP > 0), 7, 0), (np.flatnonzero((flags & DOTTED) == 0), 4, 3)):
            group = np.searchsorted(stops, at)
            total = np.bincount(group, count[at], len(stops) + 1)
            full = total >= least
            if dots:
                point = np.flatnonzero(flags & POINT > 0)
                full &= np.bincount(np.searchsorted(stops, point), minlength=len(stops) + 1) >= dots
            full = full[group]
            new = np.flatnonzero(np.diff(group[full], prepend=-1))
            inside = at[full]
            if len(inside):
                mark(inside[new] - 1, inside[np.append(new[1:], len(inside)) - 1] + 2, number)
        five, opens = _head_tables()
        head = five[points]
        head = opens[head[:-2] << 10 | head[1:-1] << 5 | head[2:]]
        # numbers of persons: six digits in the text and the label that the check asks for
        per = np.add.reduceat(count, bounds[:-1], dtype=np.int64)
        capital = np.flatnonzero(points[:-1] == ord("N"))
        short = capital[(points[capital + 1] == ord("I")) & ((flags[capital - 1] & ALNUM) == 0)]
        label = np.concatenate((np.flatnonzero(head & 1 > 0), np.flatnonzero(flags & SIGN > 0)))
        label = label[per[np.searchsorted(bounds, label, side="right") - 1] >= 6]
        label = np.concatenate((short, np.array([p for p in label.tolist() if LABEL_START.match(text, p)], dtype=np.int64)))
        mark(label, label + 43, number)
        # addresses: a house number with a street before or behind it
        street = np.array([p for p in np.flatnonzero(head & 2 > 0).tolist() if STREET_FIRST.match(text, p)], dtype=np.int64)
        mark(street, street + 25, bit["address"])
        for a, b in zip(*(x.tolist() for x in _runs((flags & DECIMAL) > 0))):
            if b - a <= 4 and (text[b].isspace() or text[b].isalpha() or text[b] == ",") and HOUSE_FIRST.match(text, a):
                mark(a - 11, a + 25, bit["address"])
            if a and text[a - 1].isspace():
                low = _street_before(text, a)
                if low is None:
                    low = bounds[np.searchsorted(bounds, a, side="right") - 1]
                if low < a:
                    mark(low, a + 25, bit["address"])
    odd = np.flatnonzero(kinds == ODD)  # letters that fold to more than letters: all of their text
    for doc in np.unique(np.searchsorted(bounds, odd, side="right") - 1).tolist():
        marks[int(bounds[doc]) : int(bounds[doc + 1])] = 255
    return marks


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and not text[a].isalnum() and text[a] not in "+(":
        a += 1
    while b > a and not (text[b - 1].isalnum() or (text[b - 1] == ")" and "(" in text[a:b])):
        b -= 1
    return a, b


def resolved(kind: str, text: str, a: int, b: int, low: int) -> str:
    """The kind of a number by its form and the words before it, where the tagger mistook one number for another."""
    if kind not in ("phone", "ipv4", "id_number"):
        return kind
    span = text[a:b].strip(" .,;")
    m = IPV4.fullmatch(unicodedata.normalize("NFKC", span))
    if m and max(int(p) for p in re.findall(r"\d+", m[0])) <= 255:
        return "ipv4"
    before = re.split(r"[!?。！？;|\n\t]|[.,] ?(?=[A-ZÀ-Þ])", text[max(low, a - 42) : a])[-1]
    if ID_LABEL.search(before) and kind != "id_number":
        return "id_number"
    return "phone" if kind == "ipv4" else kind


def is_phone(text: str) -> bool:
    """Whether the digits stand in groups as telephone numbers have them."""
    if "\t" in text or "\n" in text or "," in EXTENSION.split(text)[0]:
        return False
    main = EXTENSION.split(text)[0].strip()
    if re.search(r"[^\W\d_]", main):
        return False
    groups = [len(g) for g in re.findall(r"\d+", main)]
    digits, plain = sum(groups), re.sub(r"\D", "", main)
    if not 7 <= digits <= 16 or len(groups) > 9:
        return False
    if main[0] == "+" or plain.startswith("00"):
        return digits >= 9
    if plain[0] == "0":
        return digits >= 8 and "." not in main[:2]
    if groups in ([3, 3, 4], [1, 3, 3, 4], [10], [11], [3, 7], [3, 4], [1, 10]):
        return True
    return digits == 9 and plain[0] in "6789" and groups in ([9], [3, 3, 3], [3, 2, 2, 2], [3, 6])


def _sentence_end(text: str, a: int, b: int) -> int:
    """Where a sentence ends in text[a:b], else b."""
    m = re.compile(r"[.!?。！？;|\t]\s|\n\n|[;|\t]").search(text, a, b)
    return m.start() if m else b


def check(kind: str, text: str, a: int, b: int, low: int, high: int) -> tuple[int, int] | None:
    """The exact span of an item of this kind around text[a:b] inside text[low:high], or None if it is none."""
    while a > low and text[a - 1].isalnum() and text[a].isalnum() and text[a - 1] < "⺀":
        a -= 1
    while b < high and text[b].isalnum() and text[b - 1].isalnum() and text[b] < "⺀":
        b += 1
    a, b = _trim(text, a, b)
    if a >= b:
        return None
    folded = unicodedata.normalize("NFKC", text[a:b]) if not text[a:b].isascii() else text[a:b]
    digits = sum(c.isdigit() for c in folded)
    if kind == "email":
        x, y = max(low, a - 30), min(high, b + 40)
        around = "".join(f if len(f := unicodedata.normalize("NFKC", c)) == 1 else " " for c in text[x:y])
        for m in EMAIL.finditer(around):
            if m.start() + x < b and m.end() + x > a:
                return m.start() + x, m.end() + x
        return None
    if kind == "phone":
        if a - low > 1 and text[a - 1] in ".," and text[a - 2].isdigit():
            return None
        if is_phone(folded):
            return a, b
        for m in NUMBER.finditer(text, max(low, a - 24), min(high, b + 24)):
            if m.start() < b and m.end() > a and is_phone(unicodedata.normalize("NFKC", m[0])):
                return m.start(), m.end()
        return None
    if kind == "ipv4":
        m = IPV4.search(folded)
        if not m or max(int(p) for p in re.findall(r"\d+", m[0])) > 255 or digits > 12:
            return None
        tail = text[b : min(high, b + 2)]
        head = text[max(low, a - 2) : a]
        return None if re.match(r"\.\d", tail) or re.search(r"\d\.$", head) else (a, b)
    if kind == "id_number":
        return (a, b) if digits >= 6 and ID_LABEL.search(text, max(low, a - 42), b) else None
    if kind == "address":
        x, y = max(low, a - 24), min(high, b + 40)
        for m in ADDRESS.finditer(text, x, y):
            if m.start() < b and m.end() > a and not SENTENCES.search(m[0]):
                end = max(m.end(), min(b, _sentence_end(text, m.end(), b)))
                return m.start(), m.start() + len(text[m.start() : end].rstrip())
        return None
    for m in re.finditer(r"[\t;|\n]", text[a:b]):  # a cell's border: the longer side is the name
        if m.start() < (b - a) / 2:
            return check(kind, text, a + m.end(), b, low, high)
        return check(kind, text, a, a + m.start(), low, high)
    lead = SIGNED.match(folded)
    if lead:
        a += lead.end()
        folded = folded[lead.end() :]
    words = re.findall(r"[^\W\d_][^\W\d_'’\-]*(?:['’\-][^\W\d_]+)*", folded)
    if len(words) < 2 or len(words) > 6 or digits or "\n" in text[a:b] or not all(w.isascii() or all("LATIN" in unicodedata.name(c, "") for c in w if c.isalpha()) for w in words):
        return None
    if len(words) > 3 and text[a:b].isupper():
        return None
    lowered = [w.lower() for w in words]
    if (lowered[0] in NOT_GIVEN and len(lowered[0]) > 1) or any(w in PLACE_WORDS for w in lowered) or not all(w[0].isupper() for w in words if len(w) > 2):
        return None
    if len(words[0]) == 1 and words[0].lower() != "m" and not re.match(r"\W*\w\s?\.", folded):
        return None
    titled = lowered[0] in TITLES
    if not titled and (m := PREVIOUS.search(text, max(low, a - 14), a)) and m[1].lower() in ARTICLES:
        return None
    if folded.isupper() and not titled and words[0].capitalize() not in GIVEN and words[-1].capitalize() not in GIVEN:
        around = text[max(low, a - 24) : a] + text[b : min(high, b + 24)]
        if sum(c.isupper() for c in around) > 0.6 * max(1, sum(c.isalpha() for c in around)):
            return None
    return a, b


def tagged_spans(texts: list[str | None], bias: dict[str, float] = BIAS) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of each text as the tagger gives them, in order; no rule has looked at them."""
    return _spans(texts, bias, lambda kind, text, a, b, low, high: (a, b, kind), everything=True)


def find_spans(texts: list[str | None], bias: dict[str, float] = BIAS, everything: bool = False) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of each text in order, without overlaps, after the exact checks. With `everything` all
    windows are run, also those that no check could pass; the spans are the same."""

    def exact(kind: str, text: str, a: int, b: int, low: int, high: int) -> tuple[int, int, str] | None:
        kind = resolved(kind, text, a, b, low)
        real = check(kind, text, a, b, low, high)
        return real and (*real, kind)

    return _spans(texts, bias, exact, everything)


def _tagged(text: str, points: np.ndarray, bounds: np.ndarray, bias: dict[str, float], everything: bool) -> list[tuple[int, int, int]]:
    """Spans (start, end, kind + 1) of a block. Only those with a character in reach are sure to be whole, and returned."""
    start, end = windows(bounds)
    marks = np.full(len(points), 255, dtype=np.uint8) if everything else reach(text, points, bounds)
    first, last = own(start, end)
    read = np.zeros(len(start), dtype=bool)
    ahead = np.concatenate(([0], np.cumsum(marks > 0)))
    new = np.flatnonzero(ahead[last] > ahead[first])
    tags = np.zeros(len(points), dtype=np.int8)
    while True:
        tag(points, start, end, bias, tags, new)
        read[new] = True
        kind = (tags.astype(np.int64) + 1) // 2
        change = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | ((tags[1:] % 2 == 1) & (tags[1:] > 0)))))
        ends = np.concatenate((change[1:], [len(kind)]))
        hot = kind[change] > 0
        a, b, k = change[hot], ends[hot], kind[change][hot]
        if everything or not len(a):
            break
        seen = np.bitwise_or.reduceat(np.append(marks, 0), np.stack((a, b), 1).ravel())[::2]
        near = (seen >> (k - 1)) & 1 > 0
        a, b, k = a[near], b[near], k[near]
        # a span that ends where what was read ends may go on in the next window, or begin in the one before
        right = np.searchsorted(first, b)
        right = right[(right < len(first)) & (first[np.minimum(right, len(first) - 1)] == b)]
        left = np.searchsorted(last, a[tags[a] % 2 == 0])
        left = left[(left < len(last)) & (last[np.minimum(left, len(last) - 1)] == a[tags[a] % 2 == 0])]
        new = np.union1d(left, right)
        new = new[~read[new]]
        if not len(new):
            break
    return list(zip(a.tolist(), b.tolist(), k.tolist()))


def _spans(
    texts: list[str | None], bias: dict[str, float], judge: Callable[[str, str, int, int, int, int], tuple[int, int, str] | None], everything: bool = False
) -> list[list[tuple[int, int, str]]]:
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    joined = "\n".join(t or "" for t in texts) + "\n"
    sizes = np.array([len(t or "") + 1 for t in texts], dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    points = code_points(joined)
    for a, b, k in _tagged(joined, points, bounds, bias, everything):
        doc = int(np.searchsorted(bounds, a, side="right")) - 1
        low, high = int(bounds[doc]), int(bounds[doc + 1]) - 1
        real = judge(KINDS[k - 1], joined, a, min(b, high), low, high)
        if real and (not out[doc] or out[doc][-1][1] <= real[0] - low):
            out[doc].append((real[0] - low, real[1] - low, real[2]))
    return out


def _blocks(texts: list[str | None]):
    low = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= BLOCK_CHARS:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def mask(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join(parts) + text[at:]


def personal_information(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(id, text, pii_replacements) of every row: the text with typed placeholders, counts by kind (all six keys).

    Null texts stay null and empty ones empty, with counts of 0; repeated rows stay repeated; other columns are
    dropped; an empty table gives an empty one. Without with_text only id and counts.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def kernel(batch: pa.RecordBatch):
        texts, ids = column(batch, text_col), values(batch, id_col)
        for low, high in _blocks(texts):
            found = find_spans(texts[low:high])
            counts = [{k: 0 for k in KINDS} for _ in found]
            for row, spans in zip(counts, found):
                for _, _, k in spans:
                    row[k] += 1
            out = {id_col: ids.slice(low, high - low), "pii_replacements": pa.array([list(c.items()) for c in counts], type=pa.map_(pa.string(), pa.int64()))}
            if with_text:
                out["text"] = [mask(t, s) for t, s in zip(texts[low:high], found)]
            yield out

    text = "text string, " if with_text else ""
    return map_batches(df.select(id_col, text_col), kernel, f"`{id_col}` {kind}, {text}pii_replacements map<string,bigint>")


def found_kinds(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kind): kinds of which a row's text holds an item."""
    counts = personal_information(df, id_col, text_col, with_text=False)
    return counts.select(id_col, F.explode("pii_replacements").alias("kind", "n")).filter("n > 0").select(id_col, "kind").distinct()
