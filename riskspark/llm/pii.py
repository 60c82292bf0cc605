"""Personal data: fixed patterns, and further spans that boosted trees select among broad candidates.

Everything is a DataFrame or SQL expression. The base patterns (email, ip, card, phone) always count. Generators
with high recall propose further, overlapping spans. Gradient-boosted trees score each by its format and context. No
table says what is personal data, so the trees learn from strict validators: a candidate is positive if it
overlaps a base span or has a known credential form, and the tests of the validators are not among its features. On
distinct texts kept from training, each generator gets the smallest threshold with the wanted precision. Where they
hold too few likely candidates to judge it has a fixed one, and it adds nothing where they show that it is not precise.
A candidate with a known credential form counts whatever the trees say, and without trees too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import compute_once
from ..sources.staging import stage
from .tables import col, free_name

# The base patterns. A run is entered at its first character or where the last match ended, which gives
# the same matches as the plain patterns without trying every place of a long run. A repeated group gives nothing back
# (``++``): there is one way to read it, and otherwise every repeat takes stack, whose overflow ends the executor.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:\G|(?<![0-9]))[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "secret", "number", "contact", "address")

# The generators as (kind, pattern, what a text must hold at least).
GENERATORS = (
    ("secret", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}", "[0-9]|AKIA|gh[pousr]_|sk-|xox[abpr]-"),
    ("secret", r"(?<=[=:][\x20]?[\"']?)[A-Za-z0-9_+/-]{6,}", "[=:][\\x20]?[\"']?[A-Za-z0-9_+/-]{6}"),
    ("number", r"(?<![0-9])[0-9](?:[\x20().-]{0,2}[0-9]){6,}+", "[0-9]"),
    ("contact", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9.-]{2,}", "@|[(\\[]at[)\\]]"),
    ("address", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}", "[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
)
# Credential forms that serve as positive examples, and words that stand before personal data.
CREDENTIAL = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}|xox[abpr]-[A-Za-z0-9-]{10,})$"
ASSIGNED = r"(?i)(password|passwd|pwd|token|secret|api_?key)[\x20]?[=:][\x20]?[\"']?$"
CONTEXT = (
    ("reach", r"(?i)(tel|phone|call|fax|mobil|handy|movil)"),
    ("login", r"(?i)(pass|pwd|token|secret|key|auth|login|user)"),
    ("money", r"(?i)(card|visa|iban|konto|account|tarjeta|carte)"),
    ("network", r"(?i)(ip|host|server|addr)"),
)

SPAN = "struct<kind:string,nth:int,start:int,end:int>"
NUMBERS = (
    "g0", "g1", "g2", "g3", "g4", "length", "digits", "upper", "lower", "marks", "turns", "before_sign", "before_gap",
    "after_word", *(name for name, _ in CONTEXT),
)


@dataclass(frozen=True)
class PiiConfig:
    """Trees are fitted on the candidates of every distinct text, a fifth of which is held out for the thresholds.

    A generator has the threshold ``fallback`` if fewer than ``least_rows`` distinct texts are held out with a candidate
    of that probability.
    """

    trees: int = 8
    depth: int = 3
    precision: float = 0.95
    least_rows: int = 20
    fallback: float = 0.9
    context: int = 24


@dataclass(frozen=True)
class PiiModel:
    """``margin`` is the SQL of the summed trees over a candidate ``x``; ``thresholds`` by generator, on the probability."""

    margin: str
    thresholds: dict[int, float]


def _lit(pattern: str) -> str:
    """SQL literal of a pattern."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _found(text: str, pattern: str, item: str, kind: str, must: str, context: int = 1) -> str:
    """SQL for an array of ``item`` over all matches of ``pattern``: leftmost, not overlapping, code points.

    The pieces between the matches give the places. In ``item``, ``x.m`` is the match, ``a.at + length(x.p)`` its start,
    ``x.left`` at least the last ``context`` characters before it and ``x.right`` what follows up to the next match, or that
    match; a null item is left out. What stands around a match is taken from the pieces, not sought from the start of the text.
    """
    quoted = _lit(pattern)
    both = f"named_struct('p', split({text}, {quoted}, -1), 'm', regexp_extract_all({text}, {quoted}, 0))"
    rest = "if(x.`2` = '', x.`3`, x.`2`)"
    step = (
        f"named_struct('at', a.at + length(x.p) + length(x.m), 'tail', right(concat(a.tail, x.p, x.m), {context}), "
        f"'out', if({must}, array_append(a.out, {item}), a.out))"
    )
    step = step.replace("x.left", "concat(a.tail, x.p)").replace("x.right", rest)
    pieces = "arrays_zip(t.p, t.m, slice(t.p, 2, size(t.m)), slice(t.m, 2, size(t.m)))"
    found = f"aggregate({pieces}, named_struct('at', 0, 'tail', '', 'out', cast(array() as array<{kind}>)), (a, x) -> if(x.m is null, a, {step}), a -> a.out)"
    return f"transform(array({both}), t -> {found})[0]"


_LUHN = (
    "aggregate(sequence(1, length(regexp_replace(x.m, '[^0-9]', ''))), 0, (s, k) -> s + "
    "if(k % 2 = 1, int(substring(regexp_replace(x.m, '[^0-9]', ''), -k, 1)), "
    "2 * int(substring(regexp_replace(x.m, '[^0-9]', ''), -k, 1)) - if(int(substring(regexp_replace(x.m, '[^0-9]', ''), -k, 1)) > 4, 9, 0))) % 10 = 0"
)
_DIGITS = "length(regexp_replace(x.m, '[^0-9]', ''))"
_BYTE = "forall(split(x.m, '[.]'), q -> length(regexp_replace(q, '^0+', '')) <= 2 or (length(regexp_replace(q, '^0+', '')) = 3 and regexp_replace(q, '^0+', '') <= '255'))"


def base_spans(text: str) -> str:
    """SQL for the spans of the fixed patterns, in the order of start and kind. ``text`` is SQL that is not null."""
    span = "named_struct('kind', '{0}', 'nth', {1}, 'start', a.at + length(x.p), 'end', a.at + length(x.p) + length(x.m))"
    valid = ("true", _BYTE, f"{_DIGITS} between 12 and 19 and {_LUHN}", f"{_DIGITS} between 9 and 15")
    need = (f"contains({text}, '@')", f"{text} rlike '[0-9][.][0-9]'", f"{text} rlike r'(?:[0-9][\\x20-]?){{12}}'", f"contains({text}, '+')")
    none = f"cast(array() as array<{SPAN}>)"
    parts = [
        f"if({need[k]}, {_found(text, p, span.format(KINDS[k], k), SPAN, valid[k])}, {none})"
        for k, p in enumerate((EMAIL, IP, CARD, PHONE))
    ]
    key = "named_struct('start', {0}.start, 'nth', {0}.nth)"
    order = f"(l, r) -> case when {key.format('l')} < {key.format('r')} then -1 when {key.format('l')} > {key.format('r')} then 1 else 0 end"
    return f"array_sort(concat({', '.join(parts)}), {order})"


def candidates(text: str, cfg: PiiConfig) -> str:
    """SQL for the proposed spans with their features. Spans of one generator do not overlap, others may."""
    fields = ["kind:string", "gen:int", "start:int", "end:int", "known:boolean", *(f"{n}:double" for n in NUMBERS)]
    kind = f"struct<{','.join(fields)}>"
    left, before, after = f"right(x.left, {cfg.context})", "right(x.left, 1)", "left(x.right, 1)"
    parts = []
    for g, (name, pattern, must) in enumerate(GENERATORS):
        number = {
            **{f"g{i}": "1" if i == g else "0" for i in range(len(GENERATORS))},
            "length": "length(x.m)",
            "digits": r"regexp_count(x.m, '[0-9]') / length(x.m)",
            "upper": r"regexp_count(x.m, '[A-Z]') / length(x.m)",
            "lower": r"regexp_count(x.m, '[a-z]') / length(x.m)",
            "marks": r"regexp_count(x.m, '[^A-Za-z0-9]') / length(x.m)",
            "turns": r"regexp_count(x.m, '[0-9][A-Za-z]') / length(x.m)",
            "before_sign": f"if({before} rlike '[=:+\"(]', 1, 0)",
            "before_gap": f"if({before} = '' or {before} rlike r'\\s', 1, 0)",
            "after_word": f"if({after} rlike '[A-Za-z0-9@]', 1, 0)",
            **{n: f"if({left} rlike {_lit(rx)}, 1, 0)" for n, rx in CONTEXT},
        }
        known = f"x.m rlike {_lit(CREDENTIAL)} or (x.m rlike '[0-9]' and {left} rlike {_lit(ASSIGNED)})"
        values = [f"'{name}'", str(g), "a.at + length(x.p)", "a.at + length(x.p) + length(x.m)", known, *(f"cast({number[n]} as double)" for n in NUMBERS)]
        names = [f.split(":")[0] for f in fields]
        item = f"named_struct({', '.join(f'{n!r}, {v}' for n, v in zip(names, values, strict=True))})"
        wanted = f"x.m rlike '[0-9]' or x.m rlike {_lit(CREDENTIAL)}" if name == "secret" else "true"
        parts.append(f"if({text} rlike {_lit(must)}, {_found(text, pattern, item, kind, wanted, max(cfg.context, 1))}, cast(array() as array<{kind}>))")
    return f"concat({', '.join(parts)})"


def _overlap(l: str, r: str) -> str:
    return f"({l}.start < {r}.end and {r}.start < {l}.end)"


def fit(docs: DataFrame, text_col: str = "text", cfg: PiiConfig = PiiConfig()) -> PiiModel | None:
    """Fit the trees and thresholds on all distinct texts. None if they have no candidate of either class."""
    texts = docs.select(col(docs, text_col).alias("text")).where("text is not null")
    # Once for each text, not once more for each of its candidates.
    rows = compute_once(texts, {"base": base_spans("text")}).selectExpr("xxhash64(text) as id", "base", f"{candidates('text', cfg)} as found")
    rows = rows.selectExpr("id", f"transform(found, x -> named_struct('x', x, 'label', int(x.known or exists(base, b -> {_overlap('x', 'b')})))) as found")
    # Copies of a text give equal rows. A plain inline would add a filter that searches every text a second time.
    rows = rows.selectExpr("id", "inline_outer(found)").where("label is not null").selectExpr("id", "x.*", "cast(label as double) as label").distinct()
    rows = stage(rows.withColumn("h", F.pmod("id", F.lit(1_000_000))), "candidates")
    learn, check = rows.where("h % 5 <> 0"), rows.where("h % 5 = 0")
    if len(learn.select("label").distinct().take(2)) < 2:
        return None
    vectors = VectorAssembler(inputCols=list(NUMBERS), outputCol="features")
    model = GBTClassifier(maxIter=cfg.trees, maxDepth=cfg.depth, stepSize=0.3, maxBins=16, seed=11).fit(vectors.transform(learn))
    scored = model.transform(vectors.transform(check)).withColumn("p", vector_to_array("probability")[1])
    # Probabilities in steps of 1/1000: the table of counts is bounded by the steps and generators. A text counts at its best.
    scored = scored.withColumn("step", F.floor(F.col("p") * 1000).cast("int"))
    steps = scored.groupBy("gen", "step").agg(F.count("*").alias("n"), F.sum("label").alias("right")).collect()
    best = scored.groupBy("gen", "id").agg(F.max("step").alias("step")).groupBy("gen", "step").agg(F.count("*").alias("n")).collect()
    texts_at = {(r.gen, r.step): r.n for r in best}
    thresholds = {}
    for g in range(len(GENERATORS)):
        n = right = held = 0
        likely = sum(k for (gen, step), k in texts_at.items() if gen == g and step >= cfg.fallback * 1000)
        if likely < cfg.least_rows:
            thresholds[g] = cfg.fallback
        for r in sorted((r for r in steps if r.gen == g), key=lambda r: -r.step):
            n, right, held = n + r.n, right + r.right, held + texts_at.get((g, r.step), 0)
            if held >= cfg.least_rows and right >= cfg.precision * n:
                thresholds[g] = r.step / 1000
    trees = model._java_obj.trees()
    margin = " + ".join(f"{float(w)!r}D * {_tree(t.rootNode())}" for w, t in zip(model._java_obj.treeWeights(), trees, strict=True))
    return PiiModel(margin, thresholds)


def _tree(node) -> str:
    """SQL of one tree over the candidate ``x``."""
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{node.prediction()!r}D"
    test = f"x.{NUMBERS[node.split().featureIndex()]} <= {node.split().threshold()!r}D"
    return f"if({test}, {_tree(node.leftChild())}, {_tree(node.rightChild())})"


def annotate(df: DataFrame, text_col: str, model: PiiModel | None, cfg: PiiConfig = PiiConfig()) -> tuple[DataFrame, str, str]:
    """``df`` with two new columns, whose names come back: the base spans and all spans, both arrays in text order.

    Of candidates that overlap, the likeliest stays, then the longest, then the first; none may overlap a base span.
    """
    base, found, spans = (free_name(df, n) for n in ("base_spans", "found_spans", "all_spans"))
    text = free_name(df, "plain_text")
    rows = df.withColumn(text, F.coalesce(col(df, text_col), F.lit(""))).withColumn(base, F.expr(base_spans(f"`{text}`")))
    # A known form is surer than any probability.
    margin, thresholds = (model.margin, model.thresholds) if model else ("0D", {})
    enough = " ".join(f"when x.gen = {g} then {t!r}D" for g, t in sorted(thresholds.items()))
    enough = f"case {enough} else 2 end" if enough else "2"
    scored = f"transform({candidates(f'`{text}`', cfg)}, x -> named_struct('kind', x.kind, 'gen', x.gen, 'start', x.start, 'end', x.end, 'p', if(x.known, 2D, 1 / (1 + exp(-2 * ({margin}))))))"
    passed = f"filter({scored}, x -> x.p >= {enough})"
    rows = rows.withColumn(found, F.expr(passed))
    free = f"filter({found}, x -> not exists({base}, b -> {_overlap('x', 'b')}))"
    better = "named_struct('p', y.p, 'n', y.end - y.start, 's', -y.start, 'g', -y.gen) > named_struct('p', x.p, 'n', x.end - x.start, 's', -x.start, 'g', -x.gen)"
    rows = rows.withColumn(found, F.expr(free))
    best = f"filter({found}, x -> not exists({found}, y -> {_overlap('x', 'y')} and {better}))"
    nth = " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS))
    added = f"transform({best}, x -> named_struct('kind', x.kind, 'nth', case x.kind {nth} end, 'start', x.start, 'end', x.end))"
    by_start = "(l, r) -> case when l.start < r.start or (l.start = r.start and l.nth < r.nth) then -1 when l.start = r.start and l.nth = r.nth then 0 else 1 end"
    rows = rows.withColumn(spans, F.expr(f"array_sort(concat({base}, cast({added} as array<{SPAN}>)), {by_start})"))
    return rows.drop(text, found), base, spans


def listed(spans: str) -> str:
    """SQL for ``kind:start:end``, comma-joined."""
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def personal_data(docs: DataFrame, model: PiiModel | None, id_col: str = "doc_id", text_col: str = "text", cfg: PiiConfig = PiiConfig()) -> DataFrame:
    """``doc_id``, base spans per kind (``n_email``, ``n_ip``, ``n_card``, ``n_phone``), ``base_sha256`` and ``spans``.

    Null and empty texts have no span. Repeated rows are searched alike. Other columns are ignored. An empty table gives
    no rows; without a model the base spans and the known credential forms are all.
    """
    rows = docs.select(col(docs, id_col).alias("doc_id"), col(docs, text_col).alias("text"))
    rows, base, spans = annotate(rows, "text", model, cfg)
    counts = [f"cast(size(filter({base}, s -> s.kind = '{k}')) as bigint) as n_{k}" for k in KINDS[:4]]
    return rows.selectExpr("doc_id", *counts, f"sha2({listed(base)}, 256) as base_sha256", f"{listed(spans)} as spans")


def redacted(df: DataFrame, model: PiiModel | None, text_col: str = "text", cfg: PiiConfig = PiiConfig()) -> DataFrame:
    """``df`` with every span of the text replaced by its kind in angle brackets; a null text stays null.

    Of spans that overlap, the first names the replacement and all are removed.
    """
    rows, base, spans = annotate(df, text_col, model, cfg)
    text = f"`{text_col}`"
    step = (
        f"named_struct('at', greatest(a.at, s.end), 'out', concat(a.out, substring({text}, a.at + 1, greatest(s.start - a.at, 0)), "
        "if(s.start >= a.at, concat('<', upper(s.kind), '>'), '')))"
    )
    whole = f"aggregate({spans}, named_struct('at', 0, 'out', ''), (a, s) -> {step}, a -> concat(a.out, substring({text}, a.at + 1)))"
    return rows.withColumn(text_col, F.expr(f"if(size({spans}) > 0, {whole}, {text})")).drop(base, spans)
