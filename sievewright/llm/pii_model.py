"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

KINDS = ("email", "phone", "ipv4", "id_number", "address", "name")
#: 0: outside, 1 + 2 k: first character of kind k, 2 + 2 k: a later one.
N_TAGS = 1 + 2 * len(KINDS)
PAD, SPACE, NEWLINE, IDEOGRAPH, LOWER, UPPER, SYMBOL, DIGIT = range(8)
N_SYMBOLS = 8 + 94


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """Symbol of every code point: ASCII, also of wide and accented forms, else its class; one symbol a character."""
    table = np.full(sys.maxunicode + 1, SYMBOL, dtype=np.int16)
    for code in range(0x30000):
        if 0xD800 <= code < 0xE000:
            continue
        char = chr(code)
        if char in "\n\r\x0b\x0c\x85":
            table[code] = NEWLINE
            continue
        if char.isspace():
            table[code] = SPACE
            continue
        if code >= 0x2E80 and not 0xFF00 <= code <= 0xFFEF:
            table[code] = IDEOGRAPH
            continue
        base = unicodedata.normalize("NFKD", char)[:1]
        if base and 33 <= ord(base) <= 126:
            table[code] = 8 + ord(base) - 33
        elif char in "‐‑‒–—":
            table[code] = 8 + ord("-") - 33
        elif char in "’‘":
            table[code] = 8 + ord("'") - 33
        elif char.isupper():
            table[code] = UPPER
        elif char.isalpha():
            table[code] = LOWER
        elif char.isdigit():
            table[code] = DIGIT
    return table


@lru_cache(maxsize=1)
def allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large negative number."""
    mask = np.zeros((N_TAGS, N_TAGS), dtype=np.float32)
    for to in range(2, N_TAGS, 2):
        mask[:, to] = -1e4
        mask[to - 1, to] = mask[to, to] = 0
    return mask


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, hidden: int = 32, embedding: int = 20, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p: dict[str, np.ndarray] = {"emb": rng.normal(0, 0.3, (N_SYMBOLS, embedding))}
        for d in "fb":
            self.p["wx" + d] = rng.normal(0, embedding**-0.5, (embedding, 4 * hidden))
            self.p["wh" + d] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden))
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1.0
            self.p["b" + d] = bias
        self.p["wo"] = rng.normal(0, 0.1, (2 * hidden, N_TAGS))
        self.p["bo"] = np.zeros(N_TAGS)
        self.p["tr"] = np.zeros((N_TAGS, N_TAGS))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    # --- inference ---

    def _add(self, x: np.ndarray, d: str, e: np.ndarray) -> None:
        """Adds one direction's part of the emissions to e (steps, tags, rows).

        All gates are 1 / (1 + exp(-x)), with the sign in the weights, and tanh(x) = 2 / (1 + exp(-2 x)) - 1. Rows past the
        last one that is not padded at a step are not computed.
        """
        hidden = self.h
        sign = np.repeat(np.array([-1.0, -2.0], np.float32), [3 * hidden, hidden])
        table = (self.p["emb"] @ self.p["wx" + d] + self.p["b" + d]) * sign
        wh = self.p["wh" + d] * sign
        wo = np.ascontiguousarray((self.p["wo"][:hidden] if d == "f" else self.p["wo"][hidden:]).T)
        steps, rows = x.shape
        live, index = x != PAD, x.astype(np.intp)
        used = np.where(live.any(1), rows - live[:, ::-1].argmax(1), 0).tolist()
        whole = (live.sum(1) == used).tolist()
        h, c = np.zeros((rows, hidden), np.float32), np.zeros((rows, hidden), np.float32)
        zs, sums, part = (np.empty((rows, n * hidden), np.float32) for n in (4, 4, 1))
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            n = used[t]
            z, now, p, state = zs[:n], c[:n], part[:n], h[:n]
            np.take(table, index[t, :n], axis=0, out=z, mode="clip")
            z += np.matmul(state, wh, out=sums[:n])
            np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
            now *= z[:, hidden : 2 * hidden]
            np.multiply(z[:, 3 * hidden :], 2, out=p)
            p -= 1
            p *= z[:, :hidden]
            now += p
            np.multiply(z[:, 2 * hidden : 3 * hidden], np.tanh(now, out=p), out=state)
            if not whole[t]:
                state *= live[t, :n, None]
                now *= live[t, :n, None]
            h[n:] = c[n:] = 0
            e[t, :, :n] += wo @ state.T

    def _emitted(self, x: np.ndarray) -> np.ndarray:
        """Emissions (steps, tags, rows), so that a maximum over tags runs along whole rows."""
        e = np.empty((x.shape[0], N_TAGS, x.shape[1]), np.float32)
        e[:] = self.p["bo"][:, None]
        with np.errstate(over="ignore"):  # a gate is 0 there
            for d in "fb":
                self._add(x, d, e)
        return e

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self._emitted(x).transpose(0, 2, 1)

    def decode(self, x: np.ndarray, bias: float | np.ndarray = 0.0) -> np.ndarray:
        """Best tags (steps, rows); `bias`, one or one for each kind, is added to every first character of an item."""
        e = self._emitted(x)
        e[:, 1::2] += np.broadcast_to(np.asarray(bias, dtype=np.float32), len(KINDS))[:, None]
        pad = x == PAD
        if pad.any():
            e *= ~pad[:, None]
            e[:, 1:] -= np.float32(1e4) * pad[:, None]
        trans = (self.p["tr"] + allowed()).astype(np.float32)
        steps, rows = x.shape
        later = (np.arange(N_TAGS) > 0) & (np.arange(N_TAGS) % 2 == 0)
        scores = np.empty((steps, N_TAGS, rows), dtype=np.float32)
        scores[0] = e[0] + np.where(later, np.float32(-1e4), np.float32(0))[:, None]
        free = np.flatnonzero(~later).tolist()  # outside and first characters may follow any tag, later ones only their own kind
        first, inner = np.arange(1, N_TAGS, 2), np.arange(2, N_TAGS, 2)
        begin, stay = trans[first, inner][:, None], trans[inner, inner][:, None]
        room = np.empty((N_TAGS, rows), dtype=np.float32)
        outside = np.ones(rows, dtype=bool)
        for t in range(1, steps):
            before, now = scores[t - 1], scores[t]
            for k in free:
                np.add(before, trans[:, k, None], out=room)
                np.max(room, axis=0, out=now[k])
                if not k:  # before an outside the first tag, outside, is best
                    outside &= room[0] == now[0]
            now[inner] = np.maximum(before[first] + begin, before[inner] + stay)
            now += e[t]
        tags = np.zeros((steps, rows), dtype=np.int8)
        tags[-1] = scores[-1].argmax(axis=0)
        into = np.ascontiguousarray(trans.T)
        some = np.flatnonzero(~outside | (tags[-1] > 0))  # the others are outside all through
        at = tags[-1, some]
        for t in range(steps - 1, 0, -1):
            at = (scores[t - 1][:, some].T + into[at]).argmax(axis=1)
            tags[t - 1, some] = at
        return tags

    # --- training ---

    def _run(self, x: np.ndarray, d: str, keep: list) -> np.ndarray:
        """Hidden states (steps, rows, h) of symbols (steps, rows) in one direction."""
        hidden, wh = self.h, self.p["wh" + d]
        table = self.p["emb"] @ self.p["wx" + d] + self.p["b" + d]
        steps, rows = x.shape
        h, c = np.zeros((rows, hidden), np.float32), np.zeros((rows, hidden), np.float32)
        out = np.empty((steps, rows, hidden), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table[x[t]]
            z += h @ wh
            i, f, o = (_sigmoid(z[:, k * hidden : (k + 1) * hidden]) for k in range(3))
            g = np.tanh(z[:, 3 * hidden :])
            before, last = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            keep.append((t, i, f, o, g, before, tc, last))
            live = (x[t] != PAD)[:, None]
            h, c = h * live, c * live
            out[t] = h
        return out

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of a padded batch (steps, rows) and its gradients."""
        p, hidden = self.p, self.h
        steps, rows = x.shape
        mask = (x != PAD).astype(np.float32)
        kept: dict[str, list] = {"f": [], "b": []}
        hs = {d: self._run(x, d, kept[d]) for d in "fb"}
        both = np.concatenate((hs["f"], hs["b"]), axis=2)
        e = (both @ p["wo"] + p["bo"]).astype(np.float64)
        trans = (p["tr"] + allowed()).astype(np.float64)
        start = np.where((np.arange(N_TAGS) > 0) & (np.arange(N_TAGS) % 2 == 0), -1e4, 0.0)
        alpha = np.empty((steps, rows, N_TAGS))
        alpha[0] = e[0] + start
        for t in range(1, steps):
            step = _lse(alpha[t - 1][:, :, None] + trans, 1) + e[t]
            alpha[t] = np.where(mask[t][:, None] > 0, step, alpha[t - 1])
        beta = np.zeros((steps, rows, N_TAGS))
        for t in range(steps - 2, -1, -1):
            step = _lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(mask[t + 1][:, None] > 0, step, beta[t + 1])
        z = _lse(alpha[-1], 1)
        gold = (np.take_along_axis(e, y[:, :, None].astype(np.int64), 2)[:, :, 0] * mask).sum(0)
        pair = trans[y[:-1], y[1:]] * mask[1:]
        gold = gold + pair.sum(0) + start[y[0]]
        n = mask.sum()
        value = float((z - gold).sum() / n)
        post = np.exp(alpha + beta - z[None, :, None]) * mask[:, :, None]
        de = post.copy()
        np.put_along_axis(de, y[:, :, None].astype(np.int64), np.take_along_axis(de, y[:, :, None].astype(np.int64), 2) - mask[:, :, None], 2)
        de = (de / n).astype(np.float32)
        dtr = np.zeros((N_TAGS, N_TAGS))
        for t in range(1, steps):
            joint = np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None])
            dtr += (joint * mask[t][:, None, None]).sum(0)
        np.subtract.at(dtr, (y[:-1].ravel(), y[1:].ravel()), mask[1:].ravel())
        g: dict[str, np.ndarray] = {"tr": (dtr / n * (allowed() == 0)).astype(np.float32)}
        flat = both.reshape(-1, 2 * hidden)
        g["wo"], g["bo"] = flat.T @ de.reshape(-1, N_TAGS), de.sum((0, 1))
        dboth = de @ p["wo"].T
        demb = np.zeros_like(p["emb"])
        for d, at in (("f", 0), ("b", hidden)):
            dh, dc = np.zeros((rows, hidden), np.float32), np.zeros((rows, hidden), np.float32)
            dzs, xs, lasts = [], [], []
            for t, i, f, o, gg, before, tc, last in reversed(kept[d]):
                live = mask[t][:, None]
                dh = (dh + dboth[t][:, at : at + hidden]) * live
                dc = dc * live + dh * o * (1 - tc * tc)
                dz = np.concatenate((dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)), axis=1)
                dh, dc = dz @ p["wh" + d].T, dc * f
                dzs.append(dz)
                xs.append(x[t])
                lasts.append(last)
            dz, sym = np.concatenate(dzs), np.concatenate(xs)
            g["wh" + d] = np.concatenate(lasts).T @ dz
            g["b" + d] = dz.sum(0)
            per = np.zeros((N_SYMBOLS, 4 * hidden), np.float32)
            np.add.at(per, sym, dz)
            g["wx" + d] = p["emb"].T @ per
            demb += per @ p["wx" + d].T
        g["emb"] = demb
        return value, g

    def save(self, path: str) -> None:
        np.savez_compressed(path, hidden=self.h, **{k: v.astype(np.float16) for k, v in self.p.items()})

    @classmethod
    def load(cls, path: str) -> Tagger:
        found = np.load(path)
        model = cls(int(found["hidden"]), found["emb"].shape[1])
        model.p = {k: found[k].astype(np.float32) for k in model.p}
        return model


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray], clip: float = 1.0) -> None:
        self.t += 1
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values())))
        scale = min(1.0, clip / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            params[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def encode_text(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return symbol_table()[points]


def span_tags(length: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    tags = np.zeros(length, dtype=np.int8)
    for start, end, kind in spans:
        k = KINDS.index(kind)
        tags[start:end] = 2 + 2 * k
        tags[start] = 1 + 2 * k
    return tags
