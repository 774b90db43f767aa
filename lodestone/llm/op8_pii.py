"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select. DataFrame functions only.

Only fitting, on a few thousand made-up sentences, uses numpy on the driver; the
trees become CASE expressions.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import read_table

KINDS = ["email", "ip", "card", "phone", "ssn", "iban"]
#: Base patterns. Possessive repeats and the look-behinds change no match: what they skip can't match, and matching stays linear.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "t rlike '[0-9][.][0-9]'"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "t rlike '[0-9]([ -]?[0-9]){13}'"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "t rlike '[+][0-9]'"),
}
#: Generators with a high recall and little precision, by kind.
MORE = {
    "email": (r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[a-z0-9-]++(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[a-z0-9-]++)++", "t rlike '(?i)[\\\\[(] ?at ?[\\\\])]'"),
    "phone": (r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}(?![0-9A-Za-z])", "t rlike '[0-9]{2}[)]?[ .-][0-9]{2}'"),
    "card": (r"(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9])", "t rlike '[0-9]([ -]?[0-9]){12}'"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "t rlike '[0-9]{3}-[0-9]{2}-[0-9]{4}'"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "t rlike '[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}'"),
}
SPAN = "array<struct<s:int,k:int,e:int,m:string>>"
CONTEXT = 32


def quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def luhn(d: str) -> str:
    two = f"2 * cast(substr({d}, length({d}) - i + 1, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + if(i % 2 = 1, cast(substr({d}, length({d}) - i + 1, 1) as int), cast(({two}) div 10 + ({two}) % 10 as int))) % 10 = 0"


DIGITS = "regexp_replace(z.m, '[^0-9]', '')"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
VALID = {
    "email": "true",
    "ip": "z.m rlike " + quoted(f"^{OCTET}\\.{OCTET}\\.{OCTET}\\.{OCTET}$"),
    "card": f"length({DIGITS}) between 14 and 19 and {luhn(DIGITS)}",
    "phone": f"length({DIGITS}) between 10 and 15",
}


def spans(kind: str, pattern: str, guard: str, valid: str = "true") -> str:
    """SQL for the matches in column t as structs (s, k, e, m), from the parts between the matches and their lengths in code points."""
    p = quoted(pattern)
    start = "a.pos + length(x.p[i - 1])"
    step = f"named_struct('pos', {start} + length(x.m[i - 1]), 'out', array_append(a.out, named_struct('s', {start}, 'k', {KINDS.index(kind)}, 'e', {start} + length(x.m[i - 1]), 'm', x.m[i - 1])))"
    fold = f"aggregate(sequence(1, size(x.m)), named_struct('pos', 0, 'out', cast(array() as {SPAN})), (a, i) -> {step}, a -> a.out)"
    found = f"transform(array(named_struct('p', split(t, {p}, -1), 'm', regexp_extract_all(t, {p}, 0))), x -> if(size(x.m) = 0, cast(array() as {SPAN}), {fold}))[0]"
    return f"if({guard}, filter({found}, z -> {valid}), cast(array() as {SPAN}))"


def joined(col: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({col}, z -> concat({names}[z.k], ':', z.s, ':', z.e)), ',')"


# ---------------------------------------------------------------- features of a candidate z in text t

BEFORE = f"lower(substring(t, greatest(1, z.s - {CONTEXT - 1}), least(z.s, {CONTEXT})))"
FEATURES = {
    "kind": "z.k",
    "length": "z.e - z.s",
    "digits": f"length({DIGITS})",
    "signs": "length(regexp_replace(z.m, '[A-Za-z0-9]', ''))",
    "dots": "length(regexp_replace(z.m, '[^.]', ''))",
    "blanks": "length(regexp_replace(z.m, '[^ ]', ''))",
    "bracket": "cast(z.m rlike '^[(][0-9]{2,4}[)]' as int)",
    "luhn": f"if(length({DIGITS}) between 13 and 19, cast({luhn(DIGITS)} as int), 0)",
    "date": "cast(z.m rlike '^((19|20)[0-9]{2}[ .-][0-9]{1,2}[ .-][0-9]{1,2}|[0-9]{1,2}[ .-][0-9]{1,2}[ .-](19|20)[0-9]{2})$' as int)",
    "three_three_four": "cast(z.m rlike '^[(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}$' as int)",
    "near_phone": f"cast({BEFORE} rlike '(phone|tel|call|fax|mobile|cell|dial)' as int)",
    "near_mail": f"cast({BEFORE} rlike '(mail|write|contact|reach)' as int)",
    "near_card": f"cast({BEFORE} rlike '(card|visa|credit|debit|paid)' as int)",
    "near_bank": f"cast({BEFORE} rlike '(iban|bank|account|transfer)' as int)",
    "near_ssn": f"cast({BEFORE} rlike '(ssn|social|security)' as int)",
    "near_other": f"cast({BEFORE} rlike '(version|isbn|order|ref|page|date|serial|part|range|score|model)' as int)",
}
VECTOR = "array(" + ", ".join(f"cast({x} as double)" for x in FEATURES.values()) + ")"


# ---------------------------------------------------------------- boosted trees


@dataclass(frozen=True)
class Boosted:
    """Log odds: base + sum of depth-2 trees (feature, cut, then for each side feature, cut, two leaves); least log odds by kind."""

    base: float
    trees: tuple
    least: tuple[float, ...]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, c, sides in self.trees:
            for side, (g, d, lo, hi) in zip((x[:, f] <= c, x[:, f] > c), sides):
                out += side * np.where(x[:, g] <= d, lo, hi)
        return out

    def sql(self, v: str) -> str:
        leaf = lambda s: f"if({v}[{s[0]}] <= {s[1]!r}D, {s[2]!r}D, {s[3]!r}D)"
        return " + ".join([f"{self.base!r}D", *[f"if({v}[{f}] <= {c!r}D, {leaf(a)}, {leaf(b)})" for f, c, (a, b) in self.trees]])


def split(x, g, h, rows):
    """The cut with the largest gain over the rows: feature, cut, values of both sides."""
    value = lambda m: float(-g[m].sum() / (h[m].sum() + 1.0)) * 0.3
    best = (0.0, 0, float("inf"), value(rows), 0.0)
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    for f in range(x.shape[1]):
        for c in np.unique(x[rows, f])[:-1][:64]:
            lo, hi = rows & (x[:, f] <= c), rows & (x[:, f] > c)
            if (s := gain(lo) + gain(hi) - gain(rows)) > best[0] + 1e-9:
                best = (s, f, float(c), value(lo), value(hi))
    return best[1:]


def boost(x: np.ndarray, y: np.ndarray, trees: int = 24) -> tuple[float, tuple]:
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    z, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        f, c, _, _ = split(x, g, h, np.ones(len(y), bool))
        c = min(c, 1e9)
        sides = []
        for m in (x[:, f] <= c, x[:, f] > c):
            gf, gc, lo, hi = split(x, g, h, m) if m.any() else (0, 1e9, 0.0, 0.0)
            sides.append((int(gf), float(min(gc, 1e9)), lo, hi))
            z[m] += np.where(x[m, gf] <= gc, lo, hi)
        out.append((int(f), float(c), tuple(sides)))
    return base, tuple(out)


def thresholds(margin: np.ndarray, kind: np.ndarray, y: np.ndarray, precision: float = 0.95) -> tuple[float, ...]:
    """For each kind the least log odds from which on at least `precision` of the held-out candidates are right; never under even odds."""
    out = []
    for k in range(len(KINDS)):
        m = np.argsort(-margin[kind == k], kind="stable")
        s, hit = margin[kind == k][m], np.cumsum(y[kind == k][m])
        last = np.append(s[1:] < s[:-1], True) if len(s) else np.zeros(0, bool)  # equal scores are taken together
        ok = np.flatnonzero(last & (s >= 0) & (hit / np.arange(1, len(s) + 1) >= precision)) if len(s) else []
        out.append(float(s[ok[-1]]) if len(ok) else 1e9)
    return tuple(out)


def sentences(n: int = 3000, seed: int = 8) -> list[tuple[str, int]]:
    """Made-up sentences, each with one candidate: (text, 1 if it is personal data)."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9)))

    def card(good):
        body = [int(c) for c in r.choice("3456") + d(14)]
        s = sum(v if i % 2 else (2 * v) // 10 + (2 * v) % 10 for i, v in enumerate(body))
        full = "".join(map(str, body)) + str((-s + (0 if good else r.randint(1, 9))) % 10)
        return full if r.random() < 0.5 else " ".join(full[i : i + 4] for i in range(0, 16, 4))

    yes = {
        "phone": lambda: (r.choice(["call me on", "phone:", "tel.", "my mobile is", "fax", word()]), r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}"])),
        "email": lambda: (r.choice(["mail", "write to", "contact", word()]), f"{word()} [at] {word()} [dot] com" if r.random() < 0.5 else f"{word()}(at){word()}.org"),
        "ssn": lambda: (r.choice(["ssn", "social security number", "ssn:"]), f"{d(3)}-{d(2)}-{d(4)}"),
        "iban": lambda: (r.choice(["iban", "account", "transfer to", word()]), r.choice(["DE", "FR", "ES", "GB"]) + d(2) + "".join(f" {d(4)}" for _ in range(4)) + f" {d(2)}"),
        "card": lambda: (r.choice(["card", "visa", "paid with credit card", word()]), card(True)),
    }
    no = [
        lambda: (r.choice(["date", "on", word()]), r.choice([f"20{d(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(10, 28)}.{r.randint(10, 12)}.20{d(2)}"])),
        lambda: (r.choice(["version", "model", "part"]), f"{d(2)}.{d(2)}.{d(3)}"),
        lambda: (r.choice(["isbn", "serial", "ref"]), f"978 {d(2)} {d(4)} {d(3)}"),
        lambda: (r.choice(["range", "score", word()]), f"{d(2)}-{d(2)}-{d(2)}"),
        lambda: (r.choice(["order", "serial", "ref", word()]), card(False)),
        lambda: (r.choice(["part", "order", "model"]), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (r.choice(["serial", "model", "part"]), r.choice(["AB", "XK", "PQ"]) + d(2) + "".join(f" {d(4)}" for _ in range(3))),
        lambda: (word(), f"list [at] {d(2)}.{d(2)}"),
    ]
    out = []
    for i in range(n):
        before, what = r.choice(list(yes.values()))() if i % 2 else r.choice(no)()
        out.append((f"{' '.join(word() for _ in range(r.randint(0, 6)))} {before} {what} {word()} {word()}.", i % 2))
    return out


def candidates() -> str:
    return "concat(" + ", ".join(spans(k, p, g) for k, (p, g) in MORE.items()) + ")"


@lru_cache(4)
def fitted(n: int, seed: int, _session: int) -> Boosted:
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(sentences(n, seed), "t string, y int").coalesce(4)
    rows = df.select("y", F.expr(candidates()).alias("c"), "t").select("y", F.expr(f"transform(c, z -> {VECTOR})").alias("x")).collect()
    x = np.array([v for r in rows for v in r.x]).reshape(-1, len(FEATURES))
    y = np.array([r.y for r in rows for _ in r.x], np.float64)
    fold = np.arange(len(y)) % 3 == 0
    base, trees = boost(x[~fold], y[~fold])
    raw = Boosted(base, trees, ())
    return Boosted(base, trees, thresholds(raw.margin(x[fold]), x[fold, 0].astype(int), y[fold]))


def fit(spark: SparkSession, n: int = 3000, seed: int = 8) -> Boosted:
    """The model, from n made-up sentences: two thirds for the trees, a third to calibrate the thresholds."""
    return fitted(n, seed, id(spark))


# ---------------------------------------------------------------- operator


def detect(docs: DataFrame, model: Boosted | None = None, keep: list[str] = ()) -> DataFrame:
    """(doc_id, t, base, spans): the text (null: empty), base spans, and base spans with those that the model adds.

    A span is a struct (s, k, e, m): start, number of its kind in KINDS, end
    (exclusive; both in code points) and the matched text; spans are sorted by
    start, then kind. Base spans stay. A candidate is added if its log odds reach
    its kind's threshold, no base span overlaps it, and no better candidate does
    (ties: the first). A row gives a row, null and repeated ids included. Columns
    named in keep come along, between t and base.
    """
    model = model or fit(docs.sparkSession)
    base = "array_sort(concat(" + ", ".join(spans(k, p, g, VALID[k]) for k, (p, g) in BASE.items()) + "))"
    least = "array(" + ", ".join(f"{x!r}D" for x in model.least) + ")"
    scored = f"transform(transform(c, z -> named_struct('z', z, 'v', {VECTOR})), w -> named_struct('s', w.z.s, 'k', w.z.k, 'e', w.z.e, 'm', w.z.m, 'o', {model.sql('w.v')}))"
    free = f"filter({scored}, z -> z.o >= {least}[z.k] and not exists(base, b -> b.s < z.e and z.s < b.e))"
    best = "filter(d, z -> not exists(d, b -> b.s < z.e and z.s < b.e and (b.o > z.o or (b.o = z.o and (b.s < z.s or (b.s = z.s and b.k < z.k))))))"
    plain = "named_struct('s', z.s, 'k', z.k, 'e', z.e, 'm', z.m)"
    step = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"), *keep)
    step = step.select("doc_id", "t", *keep, F.expr(base).alias("base"), F.expr(candidates()).alias("c"))
    step = step.select("doc_id", "t", *keep, "base", F.expr(f"if(size(c) = 0, null, {free})").alias("d"))
    return step.select("doc_id", "t", *keep, "base", F.expr(f"if(d is null or size(d) = 0, base, array_sort(concat(base, transform({best}, z -> {plain}))))").alias("spans"))


def redacted(found: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(doc_id, text, n_spans): the spans' text replaced by [KIND]; of overlapping spans the first names the kind."""
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    fold = f"aggregate(spans, named_struct('pos', 0, 'out', ''), (a, z) -> named_struct('pos', greatest(a.pos, z.e), 'out', if(z.s >= a.pos, concat(a.out, substring(t, a.pos + 1, z.s - a.pos), {names}[z.k]), a.out)), a -> concat(a.out, substring(t, a.pos + 1, length(t) - a.pos)))"
    return found.select("doc_id", *keep, F.expr(f"if(size(spans) = 0, t, {fold})").alias("text"), F.size("spans").alias("n_spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(read_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, z -> z.k = {KINDS.index(k)})) as bigint)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.expr(f"sha2({joined('base')}, 256)").alias("base_sha256"), F.expr(joined("spans")).alias("spans"))
