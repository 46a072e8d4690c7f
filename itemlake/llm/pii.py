"""Personal data: base patterns, and a character BiLSTM-CRF that adds spans, trained here in numpy.

The patterns find the four base kinds as they are usually written. The tagger adds what they miss:
spelled or bracketed addresses, numbers with other separators, local phone numbers, and secrets
(keys, tokens, passwords). It learns from texts of the corpus in which the base spans and written
secrets are labelled, some base spans are rewritten, and made ones are put between words.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlake.llm.textarrays import slices

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = 4
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HIT = np.zeros(256, bool)
_HIT[list(b"0123456789@")] = True

Span = tuple[int, int, int]  # kind, start, end in code points


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind and start; the same as leftmost non-overlapping searches, in linear time."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:  # a match can only begin where the run of local characters before its @ does
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())]
    for k, pattern in ((2, _CARD), (3, _PHONE)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if (16 <= len(digits) <= 19 and _luhn(digits)) if k == 2 else 8 <= len(digits) <= 15:
                out.append((k, *m.span()))
    return out


# --- what the tagger learns -------------------------------------------------------------------

_AT, _DOT = r"(?:\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|\s+at\s+|\s*@\s*)", r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\s*\.\s*)"
_AT_FORM, _DOT_FORM = re.compile(_AT, re.I), re.compile(_DOT, re.I)
_SAID_SECRET = re.compile(r"""(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b["']?\s*[:=]\s*["']?([A-Za-z0-9+/_-]{16,})|\b(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})\b""")
#: Where a form that the tagger knows can be, besides digits and @ (also RE2).
_SPELLED = r"(?i)[\[({<]\s*(?:at|dot|\.)\s*[\])}>]|\bdot\b|\bat\s+[a-z0-9-]+\.[a-z]"
_SPELLED_AT = re.compile(_SPELLED)
_TLD = ("com", "org", "net", "de", "es", "fr", "io", "edu", "co.uk")


def _pick(rng: np.random.Generator, letters: str, lo: int, hi: int) -> str:
    return "".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(lo, hi + 1)))


def rewritten(kind: int, said: str, rng: np.random.Generator) -> str:
    """A base span in a form that the patterns don't find."""
    form = int(rng.integers(0, 8))
    if kind == 0:
        local, _, domain = said.partition("@")
        at = (" at ", " [at] ", "(at)", " (at) ", " @ ", "@", " at ", "[@]")[form]
        dot = (" dot ", " [dot] ", "(dot)", ".", " . ", " dot ", ".", "[.]")[form]
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return said.replace(".", ("[.]", " . ", " dot ", "(.)", "[dot]", " [.] ", "(dot)", ". ")[form])
    digits = re.sub("[^0-9]", "", said)
    if kind == 2:
        sep = (".", "_", "/", "  ", " - ", ".", "_", " / ")[form]
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    d = digits[-10:].rjust(10, "5")
    return (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"001 {d[:3]} {d[3:6]} {d[6:]}", f"0{d[:3]}/{d[3:]}", f"00{d[:2]} {d[2:5]} {d[5:]}", f"({d[:3]}) {d[3:6]} {d[6:]}", f"+1/{d[:3]}/{d[3:]}")[form]


def made(kind: int, rng: np.random.Generator) -> tuple[str, str, str]:
    """(before, span, after): a made span of a kind; kind -1: a figure that is no personal data."""
    low, figures = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    if kind == 0:
        return "", f"{_pick(rng, low, 3, 9)}{('', '.', '_')[rng.integers(0, 3)]}{_pick(rng, low + figures, 1, 5)}@{_pick(rng, low + figures, 4, 10)}.{_TLD[rng.integers(0, len(_TLD))]}", ""
    if kind == 1:
        return "", ".".join(str(x) for x in rng.integers(0, 256, 4)), ""
    if kind == 2:
        digits = _pick(rng, "3456", 1, 1) + _pick(rng, figures, 14, 14) if rng.integers(0, 3) else _pick(rng, "3", 1, 1) + _pick(rng, figures, 13, 13)
        return "", digits + next(c for c in figures if _luhn(digits + c)), ""
    if kind == 3:
        return "", f"+{rng.integers(1, 99)} ({rng.integers(200, 999)}) {rng.integers(200, 999)}-{rng.integers(1000, 9999)}", ""
    if kind == 4:
        name = ("token", "secret", "api_key", "password", "access_key", "API-KEY", "Token", "key")[rng.integers(0, 8)]
        eq, quote = (" = ", "=", ": ", ":")[rng.integers(0, 4)], ("", '"', "'", '"')[rng.integers(0, 4)]
        value = (_pick(rng, "0123456789abcdef", 32, 40), _pick(rng, low + low.upper() + figures, 20, 40), "AKIA" + _pick(rng, low.upper() + figures, 16, 16), "ghp_" + _pick(rng, low + low.upper() + figures, 36, 36))[rng.integers(0, 4)]
        return (f"{name}{eq}{quote}" if rng.integers(0, 6) else ""), value, quote
    year, month, day = rng.integers(1900, 2100), rng.integers(1, 13), rng.integers(1, 29)
    n = int(rng.integers(0, 10**7))
    return "", (f"{year}-{month:02}-{day:02}", f"{day}.{month}.{year}", f"{n:,}.{day:02}", f"{rng.integers(0, 24)}:{rng.integers(0, 60):02}", f"v{month}.{day}.{month}", f"Version {month}.0", str(n),
                f"978-{rng.integers(0, 9)}-{rng.integers(10, 99)}-{rng.integers(100000, 999999)}-{rng.integers(0, 9)}", f"{month}.{n}", f"meet at {month} dot", f"({day}) {n}", f"page {day}")[rng.integers(0, 12)], ""


def labelled(text: str, rng: np.random.Generator, rewrites: float = 0.5, inserts: int = 4) -> tuple[str, list[Span]]:
    """The text with a part of its base spans rewritten and made spans between its words, and all labelled spans."""
    known = base_spans(text)
    known += [(4, *m.span(1 if m[1] else 2)) for m in _SAID_SECRET.finditer(text)]
    taken, last = [], 0
    for kind, start, end in sorted(known, key=lambda x: (x[1], -x[2])):
        if start >= last:
            taken.append((kind, start, end))
            last = end
    edits = [(start, end, "", rewritten(kind, text[start:end], rng) if kind < BASE_KINDS and rng.random() < rewrites else text[start:end], "", kind) for kind, start, end in taken]
    gaps = [m.start() for m in re.finditer(r"(?<=\w) (?=\w)", text) if not any(s - 2 <= m.start() <= e + 2 for _, s, e in taken)]
    for gap in sorted(rng.choice(len(gaps), min(inserts, len(gaps)), replace=False).tolist()) if gaps else []:
        kind = int(rng.integers(-2, len(KINDS)))
        before, said, after = made(max(kind, -1), rng)
        if 0 <= kind < BASE_KINDS and rng.random() < 0.8:
            said = rewritten(kind, said, rng)
        edits.append((gaps[gap] + 1, gaps[gap] + 1, before, said, after + " ", kind))
    out, spans, at, size = [], [], 0, 0
    for start, end, before, said, after, kind in sorted(edits):
        out += [text[at:start], before, said, after]
        size += start - at + len(before)
        if kind >= 0:
            spans.append((kind, size, size + len(said)))
        size += len(said) + len(after)
        at = end
    return "".join([*out, text[at:]]), spans


# --- characters and windows -------------------------------------------------------------------

WINDOW, STRIDE, MARGIN = 80, 40, 32
_CLASSES = {c: i for i, c in enumerate("@.-+() \n%_,:/=#[]{}<>\"'*&abcdefghijklmnopqrstuvwxyz")}
_CAPITAL, _DIGIT, _WIDE, _OTHER, _NONE = range(len(_CLASSES), len(_CLASSES) + 5)
N_CLASSES = _NONE + 1
N_TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
_ASCII = np.full(128, _OTHER, np.uint8)
for _c, _i in _CLASSES.items():
    _ASCII[ord(_c)] = _i
for _c in range(128):
    if chr(_c).isdigit():
        _ASCII[_c] = _DIGIT
    elif chr(_c).isupper():
        _ASCII[_c] = _CAPITAL


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(codes < 128, _ASCII[np.minimum(codes, 127)], np.uint8(_WIDE))


def windows(codes: np.ndarray, text: str) -> list[int]:
    """Starts of overlapping windows that cover MARGIN characters about every digit, @ and spelled at or dot."""
    hits = np.flatnonzero((codes == _DIGIT) | (codes == _CLASSES["@"]))
    spelled = np.array([m.start() for m in _SPELLED_AT.finditer(text)], np.int64)
    if len(spelled):
        hits = np.unique(np.concatenate([hits, spelled]))
    if not len(hits):
        return []
    cut = np.flatnonzero(np.diff(hits) > 2 * MARGIN) + 1
    starts = []
    for part in np.split(hits, cut):
        lo, hi = max(0, int(part[0]) - MARGIN), min(len(codes), int(part[-1]) + 1 + MARGIN)
        starts += range(lo, max(lo + 1, hi - WINDOW + STRIDE), STRIDE)
    return starts


def _padded(codes: np.ndarray, starts: list[int]) -> np.ndarray:
    out = np.full((len(starts), WINDOW), _NONE, np.uint8)
    for i, s in enumerate(starts):
        part = codes[s : s + WINDOW]
        out[i, : len(part)] = part
    return out


def tags_of(spans: list[Span], n: int) -> np.ndarray:
    tags = np.zeros(n, np.int8)
    for kind, start, end in spans:
        if not tags[start:end].any():
            tags[start] = 1 + 2 * kind
            tags[start + 1 : end] = 2 + 2 * kind
    return tags


# --- the model --------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Embedding, LSTMs in both directions, and a linear-chain CRF over N_TAGS tags."""

    def __init__(self, size: int = 12, hidden: int = 20, seed: int = 3):
        rng = np.random.default_rng(seed)
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {"emb": init(N_CLASSES, size), "out": init(2 * hidden, N_TAGS), "bias": np.zeros(N_TAGS, np.float32), "trans": np.zeros((N_TAGS, N_TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": init(size, 4 * hidden), f"u{d}": init(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1  # remember at first

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """x (T, B, size) to states (T, B, hidden); d 'b' reads from the end. Gates in the order input, forget, output, cell."""
        n, (steps, batch, _) = self.hidden, x.shape
        u = self.p[f"u{d}"]
        pre = x @ self.p[f"w{d}"] + self.p[f"c{d}"]
        h = c = np.zeros((batch, n), np.float32)
        states, saved = np.empty((steps, batch, n), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ u
            g = _sigmoid(z[:, : 3 * n])
            i, f, o, a = g[:, :n], g[:, n : 2 * n], g[:, 2 * n :], np.tanh(z[:, 3 * n :])
            before_h, before_c = h, c
            c = f * c + i * a
            tc = np.tanh(c)
            h = o * tc
            states[t] = h
            if keep:
                saved.append((t, i, f, o, a, tc, before_h, before_c))
        return states, saved

    def emissions(self, codes: np.ndarray, keep: bool = False):
        x = self.p["emb"][codes.T]
        (f, sf), (b, sb) = self._lstm(x, "f", keep), self._lstm(x, "b", keep)
        h = np.concatenate([f, b], 2)
        return h @ self.p["out"] + self.p["bias"], (x, h, sf, sb)

    def loss_and_gradients(self, codes: np.ndarray, tags: np.ndarray):
        """Mean negative log likelihood of tags (B, T), and its gradients."""
        emit, (x, h, *saved) = self.emissions(codes, True)
        steps, batch, k = emit.shape
        trans = self.p["trans"]
        gold = tags.T
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[0] = emit[0]
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        for t in range(1, steps):
            alpha[t] = emit[t] + lse(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        total = lse(alpha[-1], 1)
        rows = np.arange(batch)
        score = emit[0][rows, gold[0]] + sum(emit[t][rows, gold[t]] + trans[gold[t - 1], gold[t]] for t in range(1, steps))
        d_emit = np.exp(alpha + beta - total[None, :, None])
        d_trans = np.zeros_like(trans)
        for t in range(1, steps):
            d_trans += np.exp(alpha[t - 1][:, :, None] + trans + (emit[t] + beta[t])[:, None, :] - total[:, None, None]).sum(0)
            np.subtract.at(d_trans, (gold[t - 1], gold[t]), 1)
        d_emit[np.arange(steps)[:, None], rows[None, :], gold] -= 1
        d_emit /= batch
        grads = {"trans": d_trans / batch, "bias": d_emit.sum((0, 1)), "out": np.einsum("tbh,tbk->hk", h, d_emit)}
        d_h = d_emit @ self.p["out"].T
        d_x = np.zeros_like(x)
        n = self.hidden
        for d, tape, part in (("f", saved[0], d_h[:, :, :n]), ("b", saved[1], d_h[:, :, n:])):
            u = self.p[f"u{d}"]
            back_h = back_c = np.zeros((batch, n), np.float32)
            d_z, d_u = np.empty((steps, batch, 4 * n), np.float32), np.zeros_like(u)
            for t, i, f, o, a, tc, before_h, before_c in reversed(tape):
                gh = part[t] + back_h
                gc = gh * o * (1 - tc * tc) + back_c
                z = d_z[t]
                z[:, :n], z[:, n : 2 * n] = gc * a * i * (1 - i), gc * before_c * f * (1 - f)
                z[:, 2 * n : 3 * n], z[:, 3 * n :] = gh * tc * o * (1 - o), gc * i * (1 - a * a)
                d_u += before_h.T @ z
                back_h, back_c = z @ u.T, gc * f
            grads |= {f"u{d}": d_u, f"w{d}": np.einsum("tbe,tbz->ez", x, d_z), f"c{d}": d_z.sum((0, 1))}
            d_x += d_z @ self.p[f"w{d}"].T
        grads["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(grads["emb"], codes.T, d_x)
        return float((total - score).mean()), grads

    def fit(self, codes: np.ndarray, tags: np.ndarray, steps: int = 160, batch: int = 64, rate: float = 0.02, seed: int = 5) -> list[float]:
        """Adam with a decaying rate; returns the losses."""
        rng, losses = np.random.default_rng(seed), []
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            take = rng.integers(0, len(codes), batch)
            loss, grads = self.loss_and_gradients(codes[take], tags[take])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * (1 - step / (steps + 1))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / max(norm, 1e-9))
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The best tags (B, T) of windows."""
        emit, _ = self.emissions(codes)
        steps, batch, k = emit.shape
        trans, best = self.p["trans"], emit[0]
        came = np.empty((steps, batch, k), np.int8)
        for t in range(1, steps):
            s = best[:, :, None] + trans
            came[t] = s.argmax(1)
            best = s.max(1) + emit[t]
        tags = np.empty((steps, batch), np.int8)
        tags[-1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = came[t][np.arange(batch), tags[t]]
        return tags.T


def reconcile(n: int, starts: list[int], tags: np.ndarray) -> list[Span]:
    """One tag for each character, from the window whose edges are farthest from it; then the spans."""
    best, depth = np.zeros(n, np.int8), np.full(n, -1, np.int8)
    offset = np.arange(WINDOW)
    inside = np.minimum(offset, WINDOW - 1 - offset).astype(np.int8)
    for s, row in zip(starts, tags, strict=True):
        m = min(WINDOW, n - s)
        deep = inside[:m].copy()
        if s == 0:
            deep[: WINDOW // 2] = WINDOW  # nothing is missing before a text's first character
        if s + WINDOW >= n:
            deep[-(WINDOW // 2) :] = WINDOW
        take = deep > depth[s : s + m]
        depth[s : s + m][take] = deep[take]
        best[s : s + m][take] = row[:m][take]
    spans, at = [], 0
    on = np.flatnonzero(best)
    while at < len(on):
        start, kind = int(on[at]), (int(best[on[at]]) - 1) // 2
        end = start + 1
        while end < n and best[end] == 2 + 2 * kind:
            end += 1
        spans.append((kind, start, end))
        at = int(np.searchsorted(on, end))
    return spans


def could_be(kind: int, said: str) -> bool:
    """Is a span that the tagger proposes of its kind, once its separators are read as the usual ones?"""
    digits = re.sub("[^0-9]", "", said)
    if kind == 0:
        m = re.fullmatch(rf"([A-Za-z0-9._%+-]+){_AT}([A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+)", said, re.I)
        return m is not None and re.fullmatch("[A-Za-z]{2,}", _DOT_FORM.split(m[2])[-1]) is not None
    if kind == 1:
        parts = _DOT_FORM.split(said)
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", x) and int(x) <= 255 for x in parts)
    if kind == 2:
        return 13 <= len(digits) <= 19 and _luhn(digits) and re.fullmatch(r"[0-9][0-9 ._/–-]+[0-9]", said) is not None
    if kind == 3:
        return 9 <= len(digits) <= 15 and re.fullmatch(r"[+(]?[0-9][0-9 ().+/-]+[0-9]", said) is not None and re.search(r"[ ()./-]", said) is not None
    return re.fullmatch(r"[A-Za-z0-9+/_-]{16,}", said) is not None and re.search("[0-9]", said) is not None and re.search("[A-Za-z]", said) is not None


def _whole(kind: int, start: int, end: int, text: str) -> tuple[int, int]:
    """A span's borders moved to the borders of the words at its ends, without spaces and full stops around."""
    while start < end and (text[start].isspace() or text[start] in ",;:\"'"):
        start += 1
    while start < end and (text[end - 1].isspace() or text[end - 1] in ".,;:\"'"):
        end -= 1
    while start < end and start and text[start].isalnum() and (text[start - 1].isalnum() or (kind == 4 and text[start - 1] in "_-+/")):
        start -= 1
    while start < end < len(text) and text[end - 1].isalnum() and (text[end].isalnum() or (kind == 4 and text[end] in "_-+/")):
        end += 1
    return start, end


def merge(base: list[Span], found: list[Span], text: str) -> list[Span]:
    """Base spans stay; found ones that touch none of them and could be of their kind are added."""
    out = list(base)
    taken = sorted((s, e) for _, s, e in base)
    for kind, start, end in found:
        start, end = _whole(kind, start, end, text)
        if start < end and could_be(kind, text[start:end]):
            at = bisect_left(taken, (start, end))
            if (at == len(taken) or end <= taken[at][0]) and (not at or max(e for _, e in taken[max(0, at - BASE_KINDS) : at]) <= start):
                insort(taken, (start, end))
                out.append((kind, start, end))
    return sorted(out)


# --- on Spark ---------------------------------------------------------------------------------


def training_windows(texts: list[str], sample_windows: int, rewrites: float = 0.5, versions: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(classes, tags) of at most sample_windows windows of each text, as labelled rewrites it, versions times; the text's hash is the seed."""
    every = [(np.zeros((0, WINDOW), np.uint8), np.zeros((0, WINDOW), np.int8))]
    for said, version in ((t, v) for t in texts for v in range(versions)):
        rng = np.random.default_rng([zlib.crc32(said.encode()), version])
        text, spans = labelled(said, rng, rewrites)
        codes = classes(text)
        starts = windows(codes, text)
        if starts:
            starts = sorted(rng.choice(starts, min(sample_windows, len(starts)), replace=False).tolist())
            tags = tags_of(spans, len(text))
            gold = np.zeros((len(starts), WINDOW), np.int8)
            for i, a in enumerate(starts):
                gold[i, : len(tags[a : a + WINDOW])] = tags[a : a + WINDOW]
            every.append((_padded(codes, starts), gold))
    return tuple(np.concatenate(x) for x in zip(*every, strict=True))


def train_tagger(docs: DataFrame, sample_docs: int = 1500, sample_windows: int = 6, steps: int = 400) -> Tagger | None:
    """A tagger fitted to labelled windows of about sample_docs texts (those with the smallest hashes), sample_windows of each.

    Only texts with a digit or @ are sampled; where there are few, each is labelled up to 32 times. Their number gives the threshold of the hash, so that no
    task hands on more than its share, and only the sampled texts are read and labelled; what
    reaches the driver is bounded whatever the corpus. Equal texts have equal hashes and count
    once. None if no text has a digit or @, as in an empty table.
    """

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, tags = training_windows([text], sample_windows, versions=versions)
                yield pa.RecordBatch.from_pydict({"key": [key], "codes": [codes.tobytes()], "tags": [tags.tobytes()]})

    text = F.col("text").cast("string")
    some = docs.select(F.xxhash64(text).alias("key"), text.alias("text")).filter(text.rlike("[0-9@]"))
    total = some.agg(F.approx_count_distinct("key")).first()[0]
    if not total:
        return None
    versions = max(1, min(32, sample_docs // total))
    limit = min((1 << 63) - 1, int(1.3 * sample_docs / total * 2.0**64) - (1 << 63))
    drawn = some.filter(F.col("key") <= limit).dropDuplicates(["key"])
    got = drawn.mapInArrow(cut, "key long, codes binary, tags binary").orderBy("key").limit(sample_docs).collect()
    if not any(r.codes for r in got):
        return None
    codes, tags = (np.concatenate([np.frombuffer(r[c], np.int8) for r in got]).reshape(-1, WINDOW).astype(np.int64) for c in ("codes", "tags"))
    tagger = Tagger()
    tagger.fit(codes, tags, steps)
    return tagger


def find_spans(texts: Iterable[str], tagger: Tagger | None) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base spans, all spans by kind and start) of each text; windows of many texts are decoded together, 512 at a time."""
    held: list[list] = []  # text, classes, starts, tags decoded so far

    def decode(part: list[tuple[list, int]]) -> None:
        for (row, _), tags in zip(part, tagger.decode(np.concatenate([_padded(row[1], [s]) for row, s in part])), strict=True):
            row[3].append(tags)

    def done(row: list) -> tuple[list[Span], list[Span]]:
        text, codes, starts, tags = row
        base = base_spans(text)
        return base, merge(base, reconcile(len(codes), starts, tags), text) if starts else sorted(base)

    wait: list[tuple[list, int]] = []
    for text in texts:
        codes = classes(text) if tagger is not None else np.zeros(0, np.uint8)
        held.append([text, codes, windows(codes, text) if tagger is not None else [], []])
        for s in held[-1][2]:
            wait.append((held[-1], s))
            if len(wait) == 512:
                decode(wait)
                wait = []
        while held and len(held[0][3]) == len(held[0][2]):
            yield done(held.pop(0))
    if wait:
        decode(wait)
    yield from map(done, held)


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _hits(column: pa.Array) -> tuple[np.ndarray, Iterator[str]]:
    """Rows with a digit, @ or spelled at or dot, and their texts; others hold nothing that is looked for."""
    near = np.concatenate([s.per_row(_HIT[s.data]) > 0 for s in slices(column)])
    near |= pc.fill_null(pc.match_substring_regex(column, _SPELLED), False).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(near)
    return rows, (column[int(r)].as_py() for r in rows)


_COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_data(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """Per row of docs (doc_id, text): counts and hash of the base spans, all spans with the tagger's, and how many it added.

    Windows about every digit, @ and spelled at or dot of the whole text are decoded; a text without
    any holds none of KINDS and is not looked at. A text takes a few bytes a character in a task,
    however long. Null text counts as empty; null ids and repeated rows each give a row; an empty
    table gives none. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(tagger)  # a few thousand numbers

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _COLUMNS.split(", ")]
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in it:
            if not batch.num_rows:
                continue
            counts, added = np.zeros((batch.num_rows, BASE_KINDS), np.int64), np.zeros(batch.num_rows, np.int64)
            digest, spans = [nothing] * batch.num_rows, [""] * batch.num_rows
            rows, texts = _hits(batch.column(1))
            for r, (base, found) in zip(rows, find_spans(texts, model.value), strict=True):
                counts[r] = np.bincount([k for k, _, _ in base], minlength=BASE_KINDS)
                digest[r] = hashlib.sha256(told(base).encode()).hexdigest()
                spans[r], added[r] = told(found), len(found) - len(base)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts.T), pa.array(digest), pa.array(spans), pa.array(added)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, _COLUMNS)


def redact(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """docs with [EMAIL], [IP], [CARD], [PHONE] or [SECRET] for every span of text (overlapping ones as one, named by the first).

    n_chars follows where a text changes. Every row stays, repeated ones too; null and empty texts,
    null ids and all other columns, whatever their names, are as before; an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(tagger)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cover(text: str, spans: list[Span]) -> str:
        out, end = [], 0
        for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
            if s >= end:
                out += [text[end:s], f"[{KINDS[kind].upper()}]"]
            end = max(end, e)
        return "".join([*out, text[end:]])

    def mask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            rows, texts = _hits(batch.column(at))
            done = {}
            texts = list(texts)
            for r, text, (_, spans) in zip(rows.tolist(), texts, find_spans(texts, model.value), strict=True):
                if spans:
                    done[r] = cover(text, spans)
            columns = list(batch.columns)
            if done:
                whole = columns[at].to_pylist()
                sizes = columns[size].to_pylist() if size is not None else None
                for r, text in done.items():
                    whole[r] = text
                    if sizes is not None:
                        sizes[r] = len(text)
                columns[at] = pa.array(whole, batch.schema.field(at).type)
                if sizes is not None:
                    columns[size] = pa.array(sizes, batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(mask, docs.schema)
