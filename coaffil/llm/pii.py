"""Personal data: candidate generators, boosted trees and calibrated thresholds, in SQL expressions.

The base patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers; matches
that pass the kind's check are certain and always stay.  High-recall generators, one for each kind,
propose spans in wider forms (``[at]`` and ``[dot]``, other separators, no country code, cards of 12
to 15 digits); spans of different kinds may overlap.  The verdict on a proposal that has the base
form is known from its check; for the others it is not.  Boosted depth-two trees learn the verdict
from features of format and context that mask what the base form demands (plus sign, at sign,
dots), so they can be asked about the other forms.  They are fitted on counts for each combination
of features, a table of bounded size, over the known proposals of three quarters of all texts; on
the last quarter each kind's threshold is set to the least score from which the smoothed precision
is ``precision``.  Unknown proposals that reach it are added, unless their run of overlapping spans holds a base span; of
proposals that overlap one after another the best stays.

Patterns only use possessive loops, which Java runs without recursion, and start at the end of the
last match or where no character of the run stands before, so that long runs cost linear time.
Running sums and merges go over chunks of the root of an array's size: a fold's state is copied at
each step, so one that gathered all matches would cost their square.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, with the pattern (possessive form) and the check on a match ``m``.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_digits = "regexp_replace({m}, '[^0-9]', '')"
_luhn = (
    "aggregate(sequence(1, length(d)), 0, (a, i) -> a + "
    "if((length(d) - i) % 2 = 0, int(substring(d, i, 1)), int(substring('0246813579', int(substring(d, i, 1)) + 1, 1)))) % 10 = 0"
)
CHECKS = {
    "email": "true",
    "ip": r"forall(split({m}, '\\.'), p -> length(ltrim('0', p)) <= 3 and int(concat('0', ltrim('0', p))) <= 255)",
    "card": "transform(array(" + _digits + "), d -> if(length(d) between 16 and 19, " + _luhn + ", false))[0]",
    "phone": "length(" + _digits + ") between 8 and 15",
}
_at = r"(?:@|\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20)"
_dot = r"(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)"
_point = r"(?:\.|\x20?[\[({]\x20?(?:\.|dot)\x20?[\])}]\x20?|\x20dot\x20|\x20\.\x20)"
GENERATORS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++" + _at + r"[A-Za-z0-9-]++(?:" + _dot + r"[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]{1,4}+" + (_point + "[0-9]{1,4}+") * 3,
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}+[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.+-])\+?\(?[0-9]{1,4}+\)?(?:[\x20./-]{1,2}+\(?[0-9]{2,5}+\)?){1,5}+(?![0-9])",
}
#: Texts that can hold any: the pattern that must occur.
HINTS = {
    "email": r"@|[\[({\x20]at[\])}\x20]", "ip": r"[0-9](?:\.|\x20?[\[({]\x20?(?:\.|dot)|\x20dot|\x20\.)", "card": r"[0-9](?:[\x20./_-]{0,2}[0-9]){11}", "phone": r"[0-9]\)?[\x20./-]{1,2}\(?[0-9]",
}
_span = "struct<kind:int,s:int,e:int,m:string,pre:string,post:string>"
_words = {
    0: "mail|contact|write|address", 1: "host|server|addr|from|ip", 2: "card|visa|credit|pay|account", 3: "phone|tel|call|fax|mobile",
}
FEATURES = ["kind", "size", "parts", "seps", "last", "before", "word"]


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(values: str, step: str) -> str:
    """Running results of the associative ``step`` of ``a`` and ``x`` over a non-empty array, as many as it has values.

    First within chunks of about the root of its size, then over the chunks' last results.
    """
    within = f"aggregate(slice(c, 2, size(c)), slice(c, 1, 1), (t, x) -> array_append(t, {_let('element_at(t, -1)', 'a', step)}))"
    chunks = f"transform(sequence(0, (size(v) - 1) div int(ceil(sqrt(size(v))))), k -> {_let('slice(v, k * int(ceil(sqrt(size(v)))) + 1, int(ceil(sqrt(size(v)))))', 'c', within)})"
    lasts = "transform(slice(r, 1, size(r) - 1), c -> element_at(c, -1))"
    over = f"transform(r, (c, k) -> if(k = 0, c, {_let('o[k - 1]', 'a', f'transform(c, x -> {step})')}))"
    carried = f"if(size(r) = 1, r, {_let(_let(lasts, 'c', within), 'o', over)})"
    return _let(values, "v", f"flatten({_let(chunks, 'r', carried)})")


def _matches(text: str, pattern: str, when: str, kind: int) -> str:
    """Spans of the pattern's leftmost non-overlapping matches; the pieces between the matches give the places, in code points."""
    ends = _running("zip_with(slice(p, 1, size(m)), m, (y, z) -> length(y) + length(z))", "a + x")
    spans = (
        f"transform(m, (y, i) -> named_struct('kind', {kind}, 's', n[i] - length(y), 'e', n[i], "
        "'m', y, 'pre', right(p[i], 24), 'post', left(p[i + 1], 2)))"
    )
    found = _let(f"split({text}, {_literal(pattern)}, -1)", "p", _let(ends, "n", spans))
    none = f"cast(array() as array<{_span}>)"
    return _let(f"if({when}, regexp_extract_all({text}, {_literal(pattern)}, 0), cast(array() as array<string>))", "m", f"if(size(m) = 0, {none}, {found})")


def _runs(spans: str, best: str) -> str:
    """Runs (s, e, best) of overlapping spans (s, e, best), in order: of the spans' ``best`` the one chosen by ``best`` of ``a`` and ``x``."""
    step = f"if(x.s >= a.e, x, named_struct('s', a.s, 'e', greatest(a.e, x.e), 'best', if({best}, x.best, a.best)))"
    return _let(_running(f"array_sort({spans})", step), "w", "filter(w, (y, i) -> i = size(w) - 1 or w[i + 1].s > y.s)")


class Scan:
    """``docs`` with one struct column (text, base, more) of a name that no column has."""

    def __init__(self, docs: DataFrame, text_col: str):
        self.name = "pii_scan"
        while self.name in {c.lower() for c in docs.columns}:
            self.name += "_"
        text = self.name
        docs = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
        hints = {"email": f"contains({text}, '@')", "ip": f"{text} rlike '[0-9]\\\\.[0-9]'", "card": f"{text} rlike '[0-9]'", "phone": f"contains({text}, '+')"}
        base = [f"filter({_matches(text, PATTERNS[kind], hints[kind], k)}, x -> {CHECKS[kind].format(m='x.m')})" for k, kind in enumerate(KINDS)]
        more = [_matches(text, GENERATORS[kind], f"{text} rlike {_literal(HINTS[kind])}", k) for k, kind in enumerate(KINDS)]
        slim = f"transform(concat({', '.join(base)}), x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e))"
        self.docs = docs.withColumn(text, F.expr(f"named_struct('text', {text}, 'base', {slim}, 'more', concat({', '.join(more)}))"))


def _features(x: str) -> str:
    """Format and context features of a span, each with few values; what the base form demands is masked."""
    edge = f"case when {x}.pre rlike '[A-Za-z0-9]$' then 1 when {x}.pre rlike '[^\\\\s]$' then 2 else 0 end"
    word = " ".join(f"when {x}.kind = {k} then {x}.pre rlike '(?i)({w})'" for k, w in _words.items())
    parts = f"split(regexp_replace({x}.m, '^[^0-9A-Za-z]+|[^0-9A-Za-z]+$', ''), '(?i)[\\\\s\\\\[({{]+(at|dot)[\\\\s\\\\])}}]+|[^0-9A-Za-z]+')"
    seps = f"array_distinct(filter(split(translate({x}.m, '+()[]{{}}@', ''), '[0-9A-Za-z]+'), c -> c <> ''))"
    return (
        f"named_struct('kind', {x}.kind, 'size', least(length({_digits.format(m=x + '.m')}) div 4, 6), 'parts', least(size({parts}), 6), "
        f"'seps', if({x}.kind = 0 or {x}.kind = 1, 0, least(size({seps}), 2)), 'last', least(length(element_at({parts}, -1)), 6), "
        f"'before', {edge}, 'word', int(case {word} end))"
    )


def _verdict(x: str) -> str:
    """1 or 0 where the base form or a check of the kind decides on the span, else null."""
    m = f"{x}.m"
    form = {k: f"{m} rlike {_literal('^(?:' + PATTERNS[k].replace(chr(92) + 'G|', '') + ')$')}" for k in KINDS}
    passed = {k: f"({form[k]} and {CHECKS[k].format(m=m)})" for k in KINDS}
    luhn = _let(_digits.format(m=m), "d", _luhn)
    digits = f"length({_digits.format(m=m)})"
    wide = f"exists(split(regexp_replace({m}, '[^0-9]+', ' '), ' '), p -> length(p) > 3 or int(concat('0', p)) > 255)"
    date = f"{m} rlike '^(19|20)[0-9]{{2}}[-./][0-9]{{1,2}}[-./][0-9]{{1,2}}$'"
    return (
        f"case {x}.kind when 0 then if({form['email']}, 1, null) "
        f"when 1 then case when {passed['ip']} then 1 when {form['ip']} or {wide} then 0 end "
        f"when 2 then case when not {luhn} then 0 when {passed['card']} then 1 end "
        f"else case when {passed['phone']} then 1 when {digits} not between 7 and 15 or {form['phone']} or {passed['ip']} or {passed['card']} or {date} then 0 end end"
    )


def _boost(x: np.ndarray, n: np.ndarray, pos: np.ndarray, rounds: int = 24, rate: float = 0.3) -> tuple[float, list]:
    """Gradient boosting with logistic loss over rows of features with counts and positives: start score and depth-two trees.

    A tree is (feature, value, (feature, value, leaf, leaf) if equal, the same if not).
    """
    start = math.log((pos.sum() + 1) / ((n - pos).sum() + 1))
    score = np.full(len(x), start)
    splits = sorted({(f, int(v)) for f in range(x.shape[1]) for v in x[:, f]})
    equal = np.array([x[:, f] == v for f, v in splits], float)

    def best(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, int, float, float, np.ndarray]:
        g, h = equal @ (grad * rows), equal @ (hess * rows)
        g2, h2 = (grad * rows).sum() - g, (hess * rows).sum() - h
        k = int(np.argmax(np.round(g * g / (h + 1) + g2 * g2 / (h2 + 1), 9)))
        return *splits[k], float(g[k] / (h[k] + 1)), float(g2[k] / (h2[k] + 1)), equal[k] > 0

    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = pos - n * p, n * p * (1 - p)
        f, v, _, _, same = best(np.ones(len(x)), grad, hess)
        halves = []
        for rows in (same, ~same):
            f2, v2, a, b, same2 = best(rows.astype(float), grad, hess)
            halves.append((f2, v2, rate * a, rate * b))
            score += rows * rate * np.where(same2, a, b)
        trees.append((f, v, *halves))
    return start, trees


def _tree_values(x: np.ndarray, start: float, trees: list) -> np.ndarray:
    def half(h: tuple) -> np.ndarray:
        return np.where(x[:, h[0]] == h[1], h[2], h[3])

    return start + sum((np.where(x[:, t[0]] == t[1], half(t[2]), half(t[3])) for t in trees), np.zeros(len(x)))


def _tree_sql(x: str, start: float, trees: list) -> str:
    half = lambda h: f"if({x}.{FEATURES[h[0]]} = {h[1]}, {h[2]!r}D, {h[3]!r}D)"
    return " + ".join([f"{start!r}D", *(f"if({x}.{FEATURES[t[0]]} = {t[1]}, {half(t[2])}, {half(t[3])})" for t in trees)])


def fit(scan: Scan, precision: float = 0.9) -> tuple[float, list, dict[int, float]]:
    """Start score, trees and each kind's threshold (infinite without evidence), from counts over all known proposals."""
    # Exploded first: a generator keeps the optimiser from copying the scans into every feature.
    rows = scan.docs.select(F.col(f"{scan.name}.more").alias("more"), F.expr(f"pmod(xxhash64({scan.name}.text), 4) = 0").alias("apart"))
    rows = rows.select(F.explode("more").alias("x"), "apart")
    rows = rows.select(F.expr(_features("x")).alias("f"), F.expr(_verdict("x")).alias("y"), "apart").where("y is not null")
    # At most 4 * 7 * 7 * 3 * 7 * 3 * 2 combinations, twice, whatever the corpus.
    found = rows.groupBy("f", "apart").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()
    if not found:
        return 0.0, [], {k: math.inf for k in range(len(KINDS))}
    found = sorted((r.apart, *r.f, r.n, r.pos) for r in found)
    x, n, pos = np.array([r[1:-2] for r in found], int), np.array([r[-2] for r in found], float), np.array([r[-1] for r in found], float)
    apart = np.array([r[0] for r in found], bool)
    start, trees = _boost(x[~apart], n[~apart], pos[~apart]) if not apart.all() else (0.0, [])
    limits = {}
    for k in range(len(KINDS)):
        own = apart & (x[:, 0] == k)
        score = _tree_values(x[own], start, trees)
        limits[k], n_sum, p_sum = math.inf, 0.0, 0.0
        for s in sorted({*score.tolist()}, reverse=True):
            n_sum, p_sum = n_sum + n[own][score == s].sum(), p_sum + pos[own][score == s].sum()
            if (p_sum + 1) / (n_sum + 2) >= precision:
                limits[k] = s - 1e-9
    return start, trees, limits


def _added(base: str, scored: str) -> str:
    """The best proposal (with score) of each run of overlapping spans that holds no base span."""
    one = "named_struct('s', x.s, 'e', x.e, 'best', named_struct('kind', x.kind, 's', x.s, 'e', x.e, 'score', {score}))"
    both = f"concat(transform({base}, x -> {one.format(score='double(1e9)')}), transform({scored}, x -> {one.format(score='x.score')}))"
    better = "x.best.score > a.best.score or x.best.score = a.best.score and x.best.e - x.best.s > a.best.e - a.best.s"
    return f"transform(filter({_runs(both, better)}, y -> y.best.score < 1e9), y -> named_struct('kind', y.best.kind, 's', y.best.s, 'e', y.best.e))"


def pii_spans(docs: DataFrame, text_col: str = "text", precision: float = 0.9) -> DataFrame:
    """``docs`` with ``pii_base`` and ``pii_spans``: arrays of (kind, s, e), sorted by kind and start.

    Places are code points, ends exclusive.  A null or empty text has no spans.  ``pii_spans`` holds
    the base spans and the proposed ones that were added; added spans overlap no other span.  All
    columns of ``docs`` are kept, whatever their names; columns named like the two new ones are replaced.
    """
    scan = Scan(docs.drop("pii_base", "pii_spans"), text_col)
    start, trees, limits = fit(Scan(docs.select(text_col), text_col), precision)
    t = scan.name
    some = {k: v for k, v in limits.items() if v < math.inf}
    if some:
        limit = "case x.kind " + " ".join(f"when {k} then {v!r}D" for k, v in some.items()) + " end"
        score = _let(_features("x"), "f", _tree_sql("f", start, trees))
        unknown = f"filter({t}.more, x -> x.kind in ({', '.join(map(str, some))}) and ({_verdict('x')}) is null)"
        scored = f"filter(transform({unknown}, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, 'score', {score})), x -> x.score >= {limit})"
        more = _let(scored, "g", f"if(size(g) = 0, slice({t}.base, 1, 0), {_added(t + '.base', 'g')})")
        spans = f"array_sort(concat({t}.base, {more}))"
    else:
        spans = f"{t}.base"
    return scan.docs.withColumns({"pii_base": F.expr(f"{t}.base"), "pii_spans": F.expr(spans)}).drop(t)


def redacted(docs: DataFrame, text_col: str = "text", precision: float = 0.9) -> DataFrame:
    """``docs`` with every found span of the text replaced by its kind in brackets; null texts stay null.

    A run of overlapping spans is replaced as one, by its first span's kind.  The columns are those of ``docs``.
    """
    kept = [c for c in docs.columns if c not in ("pii_base", "pii_spans")]
    if len(kept) < len(docs.columns):  # the two names stay the caller's
        held = {c: f"held_{i}_" + "_" * max(map(len, docs.columns)) for i, c in enumerate(("pii_base", "pii_spans")) if c in docs.columns}
        out = redacted(docs.withColumnsRenamed(held), text_col, precision)
        return out.withColumnsRenamed({v: k for k, v in held.items()}).select(*docs.columns)
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    cut = lambda a, n: f"decode(substring(u, 4 * {a} + 1, {n}), 'UTF-32')"  # noqa: E731  four bytes a code point: no search for the place
    runs = _runs("transform(pii_spans, x -> named_struct('s', x.s, 'e', x.e, 'best', x.kind))", "false")
    pieces = f"transform(q, (y, i) -> concat({cut('if(i = 0, 0, q[i - 1].e)', '4 * (y.s - if(i = 0, 0, q[i - 1].e))')}, {names}[y.best]))"
    rest = cut("element_at(q, -1).e", "length(u) - 4 * element_at(q, -1).e")
    clean = _let(f"encode(`{text_col}`, 'UTF-32')", "u", _let(runs, "q", f"concat(array_join({pieces}, ''), {rest})"))
    text = F.expr(f"if(size(pii_spans) = 0, `{text_col}`, {clean})")
    return pii_spans(docs, text_col, precision).withColumn(text_col, text).select(*docs.columns)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = pii_spans(docs)
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    joined = "array_join(transform({c}, x -> concat({n}[x.kind], ':', x.s, ':', x.e)), ',')"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(pii_base, x -> x.kind = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(F.expr(joined.format(c="pii_base", n=names)).cast("binary"), 256).alias("base_sha256"),
        F.expr(joined.format(c="pii_spans", n=names)).alias("spans"),
    )
