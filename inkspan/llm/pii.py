"""Personal data: fixed patterns, and a conditional random field for what they miss.

The patterns give the base spans, each in time that grows with the text alone.  A
linear-chain conditional random field over word shapes, trained from a small
labelled table, adds spans that the patterns do not describe: secrets, and numbers
or addresses in other spellings.  It decodes every word of every text, each text
as one chain from its first word to its last.  A word's emission is a sum of four
table rows, by its own shape and by the shapes and cue words beside it, so shapes
are looked at once each.  Where a word's lead for the ordinary label is more than its
neighbours could ever outweigh, the chain is cut, which changes no label, and
pieces of about one length are decoded together by Viterbi.  What the field marks is trimmed of punctuation and added unless it lies
over a base span or cannot be what it is marked as: a card number must pass Luhn,
an address must parse, a phone number has 10 to 15 digits, an e-mail address an at
sign and a dot.

Defined results: null text is empty; an empty text has no spans; a text of one
very long word or without white space is read whole; repeated rows are treated
each; an empty table gives an empty result; other columns of the input are not
read.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.common import lower_ascii, owners, passes, read, span_hash, tune, words

KINDS = ("email", "ip", "card", "phone", "secret")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = "".join(chr(c) for c in range(128) if re.match(r"[A-Za-z0-9._%+-]", chr(c)))
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Words, with padding, of the pieces that are decoded together; a longer piece is decoded alone.
TOGETHER = 1 << 16
#: Shapes that a task remembers.
SHAPES = 200_000

#: The labelled table.  Words between {kind and } belong to a span of that kind.
LABELLED = """
write to {email ana.perez@mail.example.com } before noon
reach me at {email j_doe+news@site.co.uk } or come by
the list <{email press@paper.example } > is closed
mail: {email info@press-club.org } for details
contact {email m.garcia.92@mail4.example.net } soon
send it to {email editor@daily.example.com } .
server {email root@localhost } said hello
login from {ip 10.0.0.12 } at night
the host {ip 192.168.1.254 } was down
ip {ip 203.0.113.7 } blocked after 3 tries
version 2.4.1 was out in 2019
chapter 3.2 says 45 of 100 agreed
pay with card {card 4111111111111111 } today
card {card 5500-0000-0000-0004 } was refused
her number {card 4012888888881881 } leaked
visa {card 4222 2222 2222 2220 } on file
the sum was 1234567 pesos in 2021
order 88213 came on 12/03/2020 at 10:45
call {phone +1 (809) 555-0142 } now
phone {phone +34 912 345 678 } after six
tel {phone +49-30-1234567 } office
fax {phone (212) 555-0187 } only
ring {phone 809-555-0110 } and ask
whatsapp {phone +18095550123 } any time
between 1990-2005 there were 12 cases
token = {secret "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" } in the code
api_key = {secret "AKx93kd02Lm4Pq8Zt1Rv7Yw5" } leaked
password = {secret hunter2hunter2hunter2 } here
secret: {secret c2VjcmV0LXZhbHVlLTEyMzQ1Njc4OTA= } end
key = {secret "sk-4f9a8b7c6d5e4f3a2b1c0d9e8f7a6b5c" } was found
token: {secret ghp_16C7e42F292c6912E7710c838347Ae178B4a } expired
bearer {secret eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abc123 } sent
token = {secret "2c8ba23e1529b2de52654cb5a51fb5655bd4ec6f" } and more
the key point is that token prices rose 12% in may
see http://www.example.com/a/b1?x=22 for the rest
room b12 on floor 3 has 2 doors
a verylongwordwithoutanydigitsinsideit stands here
he scored 3-1 and won 2,500 votes in 4th place
in 2024 the gdp grew 5.1% or 1.200.000.000 pesos
apartment 4b, street 27 no. 118
@daily and @press wrote about it
the address 45th street 1204 is old
mail us or call us any day
isbn 978-3-16-148410-0 on the back
plate a123456 and id 001-1234567-8 were seen
la calle 12 con 14 en 1998
""".strip().split("\n")

LABELS = ("O", *KINDS)
_EDGES = "\"'<>()[]{},;:.!?"
_CUES = {"token", "key", "api_key", "secret", "password", "bearer", "card", "visa", "call", "phone", "tel", "fax", "ring", "whatsapp", "mail", "email", "ip", "host", "=", "isbn", "id", "at", "to", "http"}


def shape_features(word: str) -> list[str]:
    core = word.strip("\"'<>()[]{},;.!?")
    shape = re.sub(r"[^\W\d_]", "a", re.sub(r"[A-Z]", "A", core))
    shape = re.sub(r"\d", "9", shape)
    packed = re.sub(r"(.)\1+", r"\1", shape)[:10]
    digits = sum(c.isdigit() for c in core)
    alphas = sum(c.isalpha() for c in core)
    n = len(core)
    size = min(n, 3) if n < 4 else 4 + (n > 7) + (n > 11) + (n > 15) + (n > 23)
    mixed = "m" if digits and alphas else "d" if digits else "a"
    out = [f"p={packed}", f"n={mixed}{size}", f"g={mixed}{min(digits, 4) + (digits > 7) + (digits > 13)}"]
    if "@" in core[1:-1]:
        out.append("at")
    if core.count(".") == 3 and digits + 3 == n:
        out.append("dots")
    if n > 15 and mixed == "m" and re.fullmatch(r"[A-Za-z0-9_\-+/=.]+", core):
        out.append("opaque")
    if word[:1] in "\"'" and n > 11:
        out.append("quoted")
    if core[:1] == "+" or word[:1] in "+(":
        out.append("plus")
    return out


def features(words_: list[str]) -> list[list[str]]:
    """Features of each word: its shape, and the shapes and cue words beside it."""
    own = [shape_features(w) for w in words_]
    low = [w.lower().strip(_EDGES) or w for w in words_]
    out = []
    for i in range(len(words_)):
        f = ["bias", *own[i]]
        for d in (-2, -1, 1):
            if 0 <= i + d < len(words_):
                f += [f"{d}{x}" for x in own[i + d][:2]]
                if low[i + d] in _CUES:
                    f.append(f"{d}c={low[i + d]}")
        out.append(f)
    return out


def labelled_rows(lines: list[str] = LABELLED) -> list[tuple[list[str], list[int]]]:
    rows = []
    for line in lines:
        words_, tags, now = [], [], 0
        for w in line.split():
            if w.startswith("{"):
                now = LABELS.index(w[1:])
            elif w == "}":
                now = 0
            else:
                words_.append(w)
                tags.append(now)
        rows.append((words_, tags))
    return rows


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x41:0x5B], _SHAPE[0x61:0x7B], _SHAPE[0x30:0x3A] = ord("A"), ord("a"), ord("9")
_EDGE = np.zeros(256, dtype=bool)
_EDGE[[ord(c) for c in _EDGES]] = True
_BESIDE = (-2, -1, 1)


class Crf:
    """index: feature to row of weights; moves: label to label."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves
        self.cues = sorted(_CUES)
        raw = np.frombuffer(" ".join(self.cues).encode(), np.uint8)
        h = span_hash(raw, *words(raw))
        self.cue_order = np.argsort(h)
        self.cue_hashes = h[self.cue_order]
        self.by_cue = np.array([[self._sum(f"{d}c={c}") for d in _BESIDE] for c in self.cues] + [np.zeros((len(_BESIDE), len(LABELS)))])
        self._forget()

    def _sum(self, *features_: str) -> np.ndarray:
        return self.weights[[self.index[f] for f in features_ if f in self.index]].sum(axis=0)

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.rows = np.zeros((1024, 1 + len(_BESIDE), len(LABELS)))

    def _shape(self, word: str) -> np.ndarray:
        own = shape_features(word)
        return np.array([self._sum("bias", *own), *(self._sum(*[f"{d}{x}" for x in own[:2]]) for d in _BESIDE)])

    def emissions(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
        """A row of label scores for each word of a pass; row tells the words' texts."""
        if len(self.known) > SHAPES:
            self._forget()
        shape = _SHAPE[buf]
        h, first, inverse = np.unique(span_hash(shape, starts, ends), return_index=True, return_inverse=True)
        raw = shape.tobytes()
        for k, x in enumerate(h.tolist()):
            if x not in self.known:
                if len(self.known) == len(self.rows):
                    self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
                self.rows[len(self.known)] = self._shape(raw[starts[first[k]] : ends[first[k]]].decode())
                self.known[x] = len(self.known)
        of = np.array([self.known[x] for x in h.tolist()], np.int64)[inverse]
        # Cue words, without the punctuation about them.
        inner = np.flatnonzero(~_EDGE[buf])
        lo = np.minimum(np.append(inner, len(buf))[np.searchsorted(inner, starts)], ends)
        hi = np.maximum(np.concatenate(([-1], inner))[np.searchsorted(inner, ends)] + 1, lo)
        lo, hi = np.where(hi > lo, lo, starts), np.where(hi > lo, hi, ends)
        cue = np.full(len(starts), len(self.cues))
        short = np.flatnonzero(hi - lo <= max(map(len, self.cues)))
        c = span_hash(lower_ascii(buf), lo[short], hi[short])
        at = np.minimum(np.searchsorted(self.cue_hashes, c), len(self.cues) - 1)
        cue[short] = np.where(self.cue_hashes[at] == c, self.cue_order[at], len(self.cues))
        out = self.rows[of, 0]
        for k, d in enumerate(_BESIDE):
            beside = self.rows[of, 1 + k] + self.by_cue[cue, k]
            n = abs(d)
            here, there = (slice(n, None), slice(None, -n)) if d < 0 else (slice(None, -n), slice(n, None))
            out[here] += np.where((row[here] == row[there])[:, None], beside[there], 0)
        return out

    def margins(self) -> np.ndarray:
        """For each label but O, how much the moves beside a word can speak for it against O at most."""
        m = self.moves
        return np.maximum((m[:, 1:] - m[:, :1]).max(axis=0), 0) + np.maximum((m[1:] - m[:1]).max(axis=1), 0)

    def viterbi(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of a batch of windows; emissions is windows x words x labels."""
        n, steps, _ = emissions.shape
        best, back = emissions[:, 0], np.zeros(emissions.shape, dtype=np.int8)
        for t in range(1, steps):
            score = best[:, :, None] + self.moves[None]
            back[:, t] = score.argmax(axis=1)
            best = np.where((t < lengths)[:, None], score.max(axis=1) + emissions[:, t], best)
        out = np.zeros((n, steps), dtype=np.int8)
        now = best.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            inside = t < lengths
            out[inside, t] = now[inside]
            now = np.where(inside & (t > 0), back[np.arange(n), t, now], now)
        return out


def train(rows: list[tuple[list[str], list[int]]], epochs: int = 60, rate: float = 0.2, decay: float = 1e-3) -> Crf:
    """Maximum likelihood by stochastic gradient ascent (AdaGrad) over forward and backward sums."""
    index: dict[str, int] = {}
    data = []
    for words_, tags in rows:
        data.append(([np.array([index.setdefault(f, len(index)) for f in fs]) for fs in features(words_)], np.array(tags)))
    k = len(LABELS)
    w, m = np.zeros((len(index), k)), np.zeros((k, k))
    gw, gm = np.full_like(w, 1e-6), np.full_like(m, 1e-6)
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for r in rng.permutation(len(data)):
            fs, y = data[r]
            e = np.array([w[f].sum(axis=0) for f in fs])
            n = len(y)
            a, b = np.zeros((n, k)), np.zeros((n, k))
            a[0] = e[0]
            for t in range(1, n):
                x = a[t - 1][:, None] + m
                top = x.max(axis=0)
                a[t] = e[t] + top + np.log(np.exp(x - top).sum(axis=0))
            for t in range(n - 2, -1, -1):
                x = m + (e[t + 1] + b[t + 1])[None]
                top = x.max(axis=1)
                b[t] = top + np.log(np.exp(x - top[:, None]).sum(axis=1))
            z = a[-1].max() + np.log(np.exp(a[-1] - a[-1].max()).sum())
            p = np.exp(a + b - z)
            dm = np.zeros_like(m)
            for t in range(1, n):
                dm -= np.exp(a[t - 1][:, None] + m + (e[t] + b[t])[None] - z)
                dm[y[t - 1], y[t]] += 1
            p = -p
            p[np.arange(n), y] += 1
            for f, g in zip(fs, p, strict=True):
                step = g - decay * w[f]
                gw[f] += step**2
                w[f] += rate * step / np.sqrt(gw[f])
            dm -= decay * m
            gm += dm**2
            m += rate * dm / np.sqrt(gm)
    return Crf(index, w, m)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the patterns match, in order.

    An address can only stand about an at sign, and dotted numbers are cut in
    fours, so nothing is looked at once for each place it might start.
    """
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        before = text[end:at]
        start = at - len(before) + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
        end = m.end() if m else at + 1
        at = text.find("@", end)
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".") if m.group().count(".") > 2 else []
        start = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            stop = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((start, stop, "ip"))
            start = stop + 1
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _is_ip(text: str) -> bool:
    try:
        return ipaddress.ip_address(text) is not None
    except ValueError:
        return False


def _valid(kind: str, text: str) -> bool:
    """Whether text can be what it is marked as."""
    digits = sum("0" <= c <= "9" for c in text)
    if kind == "email":
        return "@" in text[1:-1] and "." in text.rpartition("@")[2].strip(".")
    if kind == "card":
        return 14 <= digits <= 19 and _luhn(_NOT_DIGIT.sub("", text))
    if kind == "phone":
        return 10 <= digits <= 15
    return _is_ip(text) if kind == "ip" else bool(text)


_TRIM = "\"'<>[]{},;:!?`#$%&*|"


def added_spans(text: str, base: list, labels: np.ndarray, at: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Spans of words of equal labels that can be what they are marked as and lie over no base span.

    labels and at are of the words that have a label, in order; words beside each
    other in the text are beside each other here.
    """
    out, i = [], 0
    while i < len(at):
        j = i + 1
        while j < len(at) and labels[j] == labels[i] and not text[at[j - 1][1] : at[j][0]].strip(" \t\n\v\f\r"):
            j += 1
        if labels[i]:
            s, e = at[i][0], at[j - 1][1]
            while s < e and text[s] in _TRIM:
                s += 1
            while s < e and text[e - 1] in _TRIM + ".":
                e -= 1
            kind = LABELS[labels[i]]
            over = [b for b in base if b[0] < e and s < b[1]]
            free = not over or (kind == "secret" and all(s <= b[0] and b[1] <= e and (s, e) != b[:2] for b in over))
            if free and _valid(kind, text[s:e]):
                out.append((s, e, kind))
        i = j
    return out


def decoded(buf: np.ndarray, offsets: np.ndarray, n: int, model: Crf) -> tuple[np.ndarray, ...]:
    """(text, start, end, label) of the words of a pass that the field marks; places are in bytes of the pass."""
    starts, ends = words(buf)
    if not len(starts):
        return (np.empty(0, np.int64),) * 4
    row = owners(starts, offsets)
    scores = model.emissions(buf, starts, ends, row)
    # Where no neighbours can make another label better than O, the chain falls apart without a loss.
    lead = scores[:, :1] - scores[:, 1:]
    free = np.flatnonzero((lead <= model.margins()).any(axis=1))
    labels = np.zeros(len(starts), np.int8)
    if not len(free):
        return (np.empty(0, np.int64),) * 4
    head = np.concatenate(([True], (np.diff(free) > 1) | (row[free[1:]] != row[free[:-1]])))
    first = free[head]
    size = np.diff(np.append(np.flatnonzero(head), len(free)))
    last = first + size - 1
    inner = np.flatnonzero((first > 0) & (row[first - 1] == row[first]))
    scores[first[inner]] += model.moves[0]
    inner = last[(last + 1 < len(row)) & (row[np.minimum(last + 1, len(row) - 1)] == row[last])]
    scores[inner] += model.moves[:, 0]
    order = np.argsort(size, kind="stable")
    hi, n_parts = 0, len(order)
    while hi < n_parts:
        lo, hi = hi, hi + 1
        while hi < n_parts and (hi - lo + 1) * size[order[hi]] <= TOGETHER:
            hi += 1
        part = order[lo:hi]
        inside = np.arange(size[part].max()) < size[part][:, None]
        place = (first[part][:, None] + np.arange(inside.shape[1]))[inside]
        padded = np.zeros((*inside.shape, len(LABELS)))
        padded[inside] = scores[place]
        labels[place] = model.viterbi(padded, size[part])[inside]
    marked = np.flatnonzero(labels)
    return row[marked], starts[marked], ends[marked], labels[marked]


_HOT = np.zeros(256, dtype=bool)
_HOT[0x30:0x3A] = True
_HOT[0x40] = True


def find_spans(texts: pa.Array, model: Crf):
    """(base spans, added spans) of each text, in order; places are code points."""
    for _, n, buf, offsets in passes(texts):
        row, starts, ends, labels = decoded(buf, offsets, n, model)
        first = np.searchsorted(row, np.arange(n + 1))
        # The patterns need a digit or an at sign.
        hot = np.zeros(n, dtype=bool)
        hot[owners(np.flatnonzero(_HOT[buf]), offsets)] = True
        for k in range(n):
            base, added = [], []
            mine = slice(first[k], first[k + 1])
            if hot[k] or first[k] < first[k + 1]:
                raw = buf[offsets[k] : offsets[k + 1] - 1]
                text = raw.tobytes().decode()
                base = base_spans(text) if hot[k] else []
                if first[k] < first[k + 1]:
                    heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                    at = list(zip(heads[starts[mine] - offsets[k]].tolist(), heads[ends[mine] - offsets[k]].tolist(), strict=True))
                    added = added_spans(text, base, labels[mine], at)
            yield base, added


def _told(spans) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def _scan(shared):
    nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")

    def run(batches):
        for b in batches:
            rows = []
            for base, added in find_spans(b.column("text"), shared.value):
                if not base and not added:
                    rows.append(nothing)
                    continue
                each = [sum(s[2] == kind for s in base) for kind in KINDS[:4]]
                every = sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))
                rows.append((*each, hashlib.sha256(_told(base).encode()).hexdigest(), _told(every)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: list[str] = LABELLED) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled_rows(labelled)))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(_scan(shared), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))
