"""Personal data: proposed spans, judged by gradient-boosted trees, beside a fixed base.

The base finds emails, IPv4 addresses, payment cards and phone numbers by
pattern and check. Generators with high recall propose more spans, overlapping
ones too: disguised emails, and runs of digits with any separators, whole and
from each group of digits to each other one, as a phone number, a card or an
address. Trees boosted on the logistic loss see each
span's format and context (never the whole text) and a Platt scale turns their
sum into a probability; a threshold for each kind selects what is added. Trees,
scale and thresholds are each fitted on examples of their own. Examples are made by rule in
this module, from formats and carrier words, so the model is the same in every
run and needs no corpus.

Offsets are code points, end exclusive. Nulls: a null text is empty and has no
spans. Work grows in proportion to the text, however long and dense in numbers
it is. Rows are independent, so ties, repeats and empty tables need no care.
Other columns pass through `redacted` and are ignored by `found`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cluster import bounded_batches

KINDS = ("email", "ip", "card", "phone")
RANK = {k: i for i, k in enumerate(KINDS)}

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: The look-behind only spares starts inside a run of digits, where no leftmost match begins.
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
# The doubled digits' sums of Luhn's check.
DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(DOUBLED[x] for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind; leftmost and non-overlapping for each kind."""
    out = []
    if "@" in text:
        done = 0
        for m in DOMAIN.finditer(text):
            at = m.start()
            low = max(done, text.rfind("@", done, at) + 1)
            start = low + len(text[low:at].rstrip(LOCAL))
            if start < at:
                out.append((start, m.end(), "email"))
                done = m.end()
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = NOT_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], RANK[s[2]], s[1]))


#: Proposals: an email with its signs spelt out or spaced; a run of digits with separators, as long as it goes on.
SPELT = re.compile(r"(?:\x20?[(\[{<]\x20?at\x20?[)\]}>]\x20?|\x20at\x20|\x20?@\x20?)[A-Za-z0-9-]{1,63}(?:(?:\x20?[(\[{<]\x20?dot\x20?[)\]}>]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}){1,5}", re.I)
NUMBER = re.compile(r"(?<![0-9A-Za-z.,])[+(]?[0-9](?:[\x20().\-/]{0,3}+[0-9]){6,}+")
DIGITS = re.compile("[0-9]+")


def proposals(text: str) -> Iterator[tuple[int, int, str]]:
    if "@" in text or " at " in text or "(at" in text or "[at" in text or "{at" in text or "<at" in text:
        for m in SPELT.finditer(text):
            low = max(0, m.start() - 64)
            start = low + len(text[low : m.start()].rstrip(LOCAL))
            if start < m.start():
                yield start, m.end(), "email"
    for m in NUMBER.finditer(text):
        yield from number_spans(text, m.start(), m.end())


def number_spans(text: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """Each span of 7 to 19 digits from one group of digits of a run to another, as numbers stand beside each other; by start, the longest first.

    A group has a digit at least, so a start has 13 ends at most.
    """
    groups = [g.span() for g in DIGITS.finditer(text, start, end)]
    if text[end : end + 1].isascii() and text[end : end + 1].isalnum():
        groups.pop()
    for i, (first, _) in enumerate(groups):
        s = start if i == 0 else first - (text[first - 1] == "(")
        ends, n = [], 0
        for low, high in groups[i : i + 19]:
            n += high - low
            if n > 19:
                break
            if n >= 7:
                ends.append((high, n))
        for e, n in reversed(ends):
            if n <= 15:
                yield s, e, "phone"
            if n >= 12:
                yield s, e, "card"
            if n <= 12 and text.count(".", s, e) == 3:
                yield s, e, "ip"


CONTEXT = 32
HINTS = {
    "email": ("mail", "contact", "write", "reach", "address", "correo", "schreib", "courriel"),
    "ip": ("ip", "host", "server", "addr", "client", "login", "from"),
    "card": ("card", "visa", "master", "credit", "payment", "pay", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp", "number", "ruf", "appel", "llam"),
}
AGAINST = ("order", "invoice", "version", "serial", "isbn", "sku", "id", "date", "total", "price", "page", "no.", "ref", "build", "token", "section")
FEATURES = ("email", "ip", "card", "phone", "length", "digits", "letters", "dots", "dashes", "spaces", "slashes", "parens", "plus", "groups", "longest_group", "shortest_group", "first_group", "last_group", "luhn", "parts_ok", "spelt_at", "spelt_dot", "at_sign", "tld", "hint", "against", "before_space", "after_space", "money", "distinct", "date_like", "left_size", "left_gap", "left_joined", "right_size", "right_gap", "right_joined")
LETTER, LAST, AT, DOT = re.compile(r"[^\W\d_]"), re.compile("[a-z]+$"), re.compile("[^a-z]at[^a-z]"), re.compile("[^a-z]dot[^a-z]")
DATE = re.compile(r"(?:(?:19|20)\d\d[-/. ]\d\d?[-/. ]\d\d?|\d\d?[-/. ]\d\d?[-/. ](?:19|20)\d\d)[\d: ]*")
#: The group of digits on each side that a run would join to the span, and what stands between.
LEFT, RIGHT = re.compile(r"([0-9]{1,20})([\x20().\-/]{1,3})$"), re.compile(r"([\x20().\-/]{1,3})([0-9]{1,20})")


@lru_cache(1 << 15)
def form(s: str) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """What a span alone shows: the features before the context's, and those after."""
    groups = DIGITS.findall(s)
    digits = "".join(groups)
    low = s.lower()
    sizes = [len(g) for g in groups] or [0]
    letters = sum(c.isalpha() for c in s) if LETTER.search(s) else 0
    tail = LAST.search(low) if letters else None
    return (
        len(s), len(digits), letters, s.count("."), s.count("-"), s.count(" "), s.count("/"), s.count("("), s[:1] == "+",
        len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], bool(digits) and luhn(digits), len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups),
        bool(letters and AT.search(low)), bool(letters and DOT.search(low)), "@" in s, len(tail.group()) if tail else 0,
    ), (len(set(digits)), bool(DATE.fullmatch(s)))


@lru_cache(1 << 14)
def hints(left: str, kind: str) -> tuple[bool, bool]:
    left = left.lower()
    return any(h in left for h in HINTS[kind]), any(a in left for a in AGAINST)


@lru_cache(1 << 14)
def joined_left(left: str) -> tuple[int, int, bool]:
    m = LEFT.search(left)
    return (len(m[1]), len(m[2]), " " not in m[2]) if m else (0, 0, False)


@lru_cache(1 << 14)
def joined_right(right: str) -> tuple[int, int, bool]:
    m = RIGHT.match(right)
    return (len(m[2]), len(m[1]), " " not in m[1]) if m else (0, 0, False)


def features(text: str, start: int, end: int, kind: str) -> tuple[float, ...]:
    own, more = form(text[start:end])
    before, after = text[start - 1 : start], text[end : end + 1]
    return (
        *(kind == k for k in KINDS), *own, *hints(text[max(0, start - CONTEXT) : start], kind),
        before in ("", " ", "\n", "(", ":", "<", '"'), after in ("", " ", "\n", ")", ".", ",", ";", ">", '"'), before in ("$", "€", "£", "#") or after in ("%", "€"),
        *more, *joined_left(text[max(0, start - 24) : start]), *joined_right(text[end : end + 24]),
    )


def examples(n: int = 8000, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of spans in made sentences: half personal data, half look-alikes; some stand beside other numbers, or are parts of them."""
    r = Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "er", "tion", "re", "lo", "mi", "sta", "ou", "ble")) for _ in range(r.randint(1, 4)))

    def card(valid: bool) -> str:
        body = r.choice("3456") + d(14)
        check = next(c for c in "0123456789" if luhn(body + c))
        number = body + (check if valid else str((int(check) + r.randint(1, 9)) % 10))
        sep = r.choice(("", "-", " ", ".", "/"))
        return sep.join(number[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        at, dot = r.choice(((" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", "."), (" @ ", "."), (" AT ", " DOT ")))
        return f"{word()}{r.choice(('', '.', '_'))}{word()}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr', 'io'))}"

    def phone() -> str:
        a, b, c = d(3), d(3), d(4)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+{r.randint(1, 99)} {a} {b}{c}", f"+{r.randint(1, 99)}/{a}/{b}{c}", f"0{d(3)}/{d(7)}", f"00{r.randint(30, 49)} {d(3)} {d(7)}", f"1-{a}-{b}-{c}"))

    def look_alike() -> tuple[str, str]:
        kind = r.choice(KINDS)
        date = f"{r.randint(1950, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
        return kind, {
            "email": lambda: r.choice((f"{word()} at {word()}.{word()}", f"{word()} at {r.randint(1, 12)}.{r.randint(10, 59)}", f"look at {word()}.{word()}", f"{word()} @ {r.randint(1, 99)}.{d(2)}")),
            "ip": lambda: r.choice((f"{r.randint(256, 999)}.{d(3)}.{d(3)}.{d(3)}", f"{d(4)}.{d(1)}.{d(2)}.{d(4)}", f"{r.randint(256, 999)}.{r.randint(0, 255)}.{r.randint(256, 999)}.{d(2)}")),
            "card": lambda: r.choice((card(False), d(r.randint(12, 19)), date + " " + d(6), f"{d(4)} {d(4)} {d(4)}")),
            "phone": lambda: r.choice((date, date.replace("-", "/"), d(r.randint(7, 15)), f"{d(1)}.{d(6)}", f"{d(3)}.{d(3)}.{d(3)}.{d(2)}", f"{d(4)} {d(4)}", f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(4)}/{d(4)}", card(False))),
        }[kind]()

    def beside() -> tuple[str, int, int, str, bool]:
        """Two or three numbers in a row, and a span of their run: a personal one of them, or any other part."""
        while True:
            year, month, day = r.randint(1950, 2030), r.randint(1, 12), r.randint(1, 28)
            other = lambda: r.choice((f"{year}-{month:02d}-{day:02d}", f"{day}/{month}/{year}", str(year), d(r.randint(1, 6)), f"{month:02d}/{r.randint(20, 39)}", f"{d(3)}.{d(2)}", d(r.randint(8, 20)), f"{r.randint(1, 99)} {d(2)} {d(3)}", ".".join(str(r.randint(0, 255)) for _ in range(4))))  # noqa: E731, B023
            kinds = [r.choice(("phone", "phone", "card", "", "")) for _ in range(r.randint(2, 3))]
            line, whole, alike = "", {}, r.choice((phone, None))
            same = r.choice(("({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "{0} {1} {2}", "1-{0}-{1}-{2}", "0{0}/{1}{2}", "+1 ({0}) {1}-{2}", "+1-{0}-{1}-{2}"))
            gap = r.choice((" ", " ", " / ", " - ", "  "))
            for kind in kinds:
                line += gap if line else ""
                item = {"phone": alike or (lambda: same.format(d(3), d(3), d(4))), "card": lambda: card(True), "": other}[kind]()  # noqa: B023
                if kind:
                    whole[len(line), len(line) + len(item), kind] = True
                line += item
            spans = [x for m in NUMBER.finditer(line) for x in number_spans(line, *m.span()) if x[2] != "ip"]
            yes, no = [x for x in spans if x in whole], [x for x in spans if x not in whole]
            y = r.random() < 0.5
            if yes if y else no:
                return (line, *r.choice(yes if y else no), y)

    xs, ys = [], []
    while len(ys) < n:
        if r.random() < 0.4:
            line, s, e, kind, y = beside()
            lead = r.choice((*HINTS[kind], *AGAINST)) + r.choice((" ", ": ", " is ")) if r.random() < 0.5 else ""
            text = word() + " " + lead
            start = len(text) + s
            text += line + r.choice((" ", ".", ",", "\n", "")) + word()
            xs.append(features(text, start, start + e - s, kind))
            ys.append(y)
            continue
        y = r.random() < 0.5
        if y:
            kind = r.choice(("email", "card", "phone", "ip"))
            span = {"email": email, "card": lambda: card(True), "phone": phone, "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))}[kind]()
        else:
            kind, span = look_alike()
        hints = (*HINTS[kind], *AGAINST) if r.random() < 0.15 else HINTS[kind] if y else AGAINST
        # what looks like a telephone number or an address only by luck needs its context
        lead = r.choice(hints) + r.choice((" ", ": ", " is ")) if r.random() < 0.6 else ""
        text = " ".join(word() for _ in range(r.randint(1, 6))) + " " + lead
        start = len(text)
        text += span + r.choice((" ", ".", ",", "\n", "")) + " ".join(word() for _ in range(3))
        xs.append(features(text, start, start + len(span), kind))
        ys.append(y)
    return np.array(xs, float), np.array(ys, float)


class Boosted:
    """Trees of fixed depth on the logistic loss, split at quantiles; then a Platt scale and a threshold for each kind."""

    ROUNDS, DEPTH, RATE, BINS, RIDGE = 80, 4, 0.15, 24, 1.0

    def __init__(self, x: np.ndarray, y: np.ndarray, precision: float = 0.99):
        turn = np.arange(len(y)) % 5  # three parts for the trees, one for the scale, one for the thresholds
        self.fit(x[turn < 3], y[turn < 3])
        self.scale, self.shift = self.platt(self.raw(x[turn == 3]), y[turn == 3])
        hold = turn == 4
        p, kind = self.probability(x[hold]), x[hold][:, : len(KINDS)].argmax(1)
        self.thresholds = np.full(len(KINDS), 0.5)
        for k in range(len(KINDS)):
            q, t = p[kind == k], y[hold][kind == k]
            order = np.argsort(-q)
            right = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
            good = np.flatnonzero(right >= precision)
            self.thresholds[k] = max(0.5, q[order][good[-1]]) if len(good) else 1.1

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
        self.bias = float(np.log(y.mean() / (1 - y.mean())))
        f, nodes = np.full(len(y), self.bias), (1 << self.DEPTH) - 1
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(self.ROUNDS):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            feature, cut, at = np.zeros(nodes, int), np.full(nodes, np.inf), np.zeros(len(y), int)
            for node in range(nodes):
                rows = np.flatnonzero(at == node)
                best = 1e-6
                if len(rows) >= 20:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for j, c in enumerate(cuts):
                        gl = np.cumsum(np.bincount(binned[j, rows], g[rows], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[j, rows], h[rows], len(c) + 1))[:-1]
                        gain = gl**2 / (hl + self.RIDGE) + (gs - gl) ** 2 / (hs - hl + self.RIDGE) - gs**2 / (hs + self.RIDGE)
                        if len(gain) and gain.max() > best:
                            best, feature[node], cut[node] = gain.max(), j, c[gain.argmax()]
                at[rows] = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            leaf = np.bincount(at - nodes, g, nodes + 1) / (np.bincount(at - nodes, h, nodes + 1) + self.RIDGE) * self.RATE
            f += leaf[at - nodes]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)

    def raw(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(self.DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            f += leaf[at - len(feature)]
        return f

    @staticmethod
    def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -35, 35)))
            w, e = p * (1 - p) + 1e-9, y - p
            step = np.linalg.solve([[(w * raw**2).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]], [(e * raw).sum() - 1e-3 * a, e.sum()])
            a, b = a + step[0], b + step[1]
        return float(a), float(b)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x) + self.shift, -35, 35)))


@lru_cache(maxsize=1)
def model() -> Boosted:
    return Boosted(*examples())


#: Different rows of features, and proposals, that are held at once.
JUDGED, ASKED = 4096, 1 << 16


def all_spans(texts: list[str], trees: Boosted) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(base spans, all spans) of each text. An added span overlaps no span of the base or one added with a higher probability.

    Proposals that look alike are judged once.
    """
    bases = [base_spans(t) for t in texts]
    asked: list[tuple[int, int, int, str, int]] = []
    rows: dict[tuple[float, ...], int] = {}
    good = []

    def judge() -> None:
        p = trees.probability(np.array(list(rows), float)).tolist() if rows else []
        good.extend((p[row], i, s, e, k) for i, s, e, k, row in asked if p[row] >= trees.thresholds[RANK[k]])
        asked.clear()
        rows.clear()

    taken: dict[int, bytearray] = {}
    for i, (t, base) in enumerate(zip(texts, bases, strict=True)):
        for s, e, k in proposals(t):
            if i not in taken:
                taken[i] = bytearray(len(t))
                for b in base:
                    taken[i][b[0] : b[1]] = b"\1" * (b[1] - b[0])
            if taken[i].find(1, s, e) < 0:
                asked.append((i, s, e, k, rows.setdefault(features(t, s, e, k), len(rows))))
                if len(rows) == JUDGED or len(asked) == ASKED:
                    judge()
    judge()
    added: dict[int, list[tuple[int, int, str]]] = {}
    for _, i, s, e, k in sorted(good, key=lambda g: -g[0]):
        if taken[i].find(1, s, e) < 0:
            taken[i][s:e] = b"\1" * (e - s)
            added.setdefault(i, []).append((s, e, k))
    order = lambda s: (s[0], RANK[s[2]], s[1])
    return [(b, sorted(b + added.get(i, []), key=order)) for i, b in enumerate(bases)]


SPAN = "array<struct<start:int,end:int,kind:string>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): the base's spans and all spans of each text."""
    bounded_batches(docs.sparkSession)
    trees = model()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {SPAN}, spans {SPAN}"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = lambda spans: [[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in spans]
        for batch in batches:
            made = all_spans([t or "" for t in batch.column(1).to_pylist()], trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows(m[0] for m in made), SPAN_TYPE), pa.array(rows(m[1] for m in made), SPAN_TYPE)], ["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(each, schema)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span replaced by its kind in brackets; overlapping spans by the first's."""
    out, done = [], 0
    for s, e, k in spans:
        if s >= done:
            out.append(text[done:s] + f"[{k.upper()}]")
        done = max(done, e)
    return "".join(out) + text[done:]


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the spans of `text` replaced; a null text stays null."""
    bounded_batches(docs.sparkSession)
    trees = model()

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        made = all_spans([t or "" for t in values], trees)
        return pa.array([None if t is None else redact(t, m[1]) if m[1] else t for t, m in zip(values, made, strict=True)], pa.string())

    return docs.withColumn(text, clean(F.col(text)))
