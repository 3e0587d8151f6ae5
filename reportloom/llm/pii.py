"""Personal data: rules with fixed meaning, and a boosted model over more candidates.

*Base rules* (e-mail, IP address, card, phone) are regular expressions with checks (octets,
Luhn, digit counts). Matching stays linear in the text: loops run over single
characters (a separator that belongs to a match is first replaced by a marker character of
the same length), so a long text neither backtracks nor deepens the stack.
Places come from the text between matches: pieces and matches alternate, and their lengths
add up to code points.

*Candidates.* Two generators propose spans with high recall, overlapping the base ones:
anything around an at sign or its spelled form, and any run of seven and more digits with
separators. Format features (digits, groups, separators, Luhn, octets, ...) and context
features (what stands before and after) describe each. A gradient-boosted tree model is
trained on all candidates (equal texts count once) with the base rules as teachers: a
candidate that overlaps a base span is positive, any other negative, except forms that the
rules cannot see (an address with a spelled at sign, a phone with area code but no country
code): these teach nothing, and their features are those of the form that they stand for.
Candidates that look the same are one row with their number as weight. On a held-out
third, each kind gets the lowest score at which at least ``precision`` of the candidates are
positive (no threshold without 20 positives). Candidates at or above it are added, where
they don't overlap a base span. The trees become ordinary column expressions, so scoring is
one projection of the scan: no shuffle, no Python.

Cases: a null text is empty. Rows stay as they are, repeated and with null ids; an empty
table gives no rows. Extra columns are not read by ``find``; ``redact`` keeps all columns
and replaces every span in the text by its kind in brackets (a null text stays null).
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.plans.store import discard, materialize

KINDS = ("email", "ip", "card", "phone")
MARK, PLAIN = "\x01", "\x03"
_LOCAL = r"A-Za-z0-9._%+\x01-"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++\x01[A-Za-z0-9\x01-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9][0-9\x01]+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# a run of local characters is tried from its start only, so a long one costs no more than its length
_AT = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9.-]{2,}+"
       r"| ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++){1,8})")
_NUMBER = r"[+(]?[0-9][0-9 ().-]{5,30}[0-9]"

_NO_SPANS = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _spans(text: Column, pattern: str, gate: Column) -> Column:
    """Places, text and surroundings of all matches; empty where ``gate`` is false."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    rows = F.arrays_zip(pieces.alias("piece"), found.alias("value"), F.slice(pieces, 2, 1 << 30).alias("next"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_NO_SPANS).alias("spans"))

    def step(acc, x):
        first = acc["at"] + F.char_length(x["piece"])
        last = first + F.coalesce(F.char_length(x["value"]), F.lit(0))
        span = F.struct(first.alias("start"), last.alias("end"), x["value"].alias("value"),
                        F.right(x["piece"], F.lit(24)).alias("before"), F.left(x["next"], F.lit(8)).alias("after"))
        return F.struct(last.alias("at"), F.when(x["value"].isNull(), acc["spans"]).otherwise(
            F.concat(acc["spans"], F.array(span))).alias("spans"))

    spans = F.aggregate(rows, start, step, lambda acc: acc["spans"])
    return F.when(gate, spans).otherwise(F.array().cast(_NO_SPANS))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of ten."""
    turned = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(turned, lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(
            (d.try_cast("int") * 2) % 10 + F.floor(d.try_cast("int") / 5).cast("int"))),
        F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return total % 10 == 0


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^[0-9]{1,3}$") & (
        F.right(p, F.lit(3)).try_cast("int") <= 255))


def with_base(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` and ``_email``, ``_ip``, ``_card``, ``_phone``: arrays of (start, end, value, before, after)."""
    held = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.when(F.contains(held, F.lit(MARK)), F.replace(held, F.lit(MARK), F.lit(PLAIN))).otherwise(held)
    df = df.withColumn("_plain", plain)
    body = F.col("_plain")
    has = {"email": F.contains(body, F.lit("@")),
           "ip": body.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
           "card": body.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
           "phone": body.rlike(r"\+[0-9]")}
    domains = F.regexp_replace(body, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)
    joined = F.regexp_replace(body, r"(?<=[0-9])[ -](?=[0-9])", MARK)
    digits = lambda s: F.char_length(_digits(s["value"]))
    return (df.withColumn("_email", _spans(domains, _EMAIL, has["email"]))
            .withColumn("_ip", F.filter(_spans(body, _IP, has["ip"]), lambda s: _octets(s["value"])))
            .withColumn("_card", F.filter(_spans(joined, _CARD, has["card"]), lambda s: digits(s).between(13, 19) & _luhn(
                _digits(s["value"]))))
            .withColumn("_phone", F.filter(_spans(body, _PHONE, has["phone"]), lambda s: digits(s).between(9, 15))))


_SPELLED_AT, _SPELLED_DOT = r" ?[\[(]at[\])] ?", r" ?[\[(]dot[\])] ?"
_AREA_PHONE = r"^(\([0-9]{2,4}\) ?[0-9]{3,4}[ -][0-9]{3,4}|[0-9]{3}([-.])[0-9]{3}\2[0-9]{4})$"

FEATURES = ("digits", "length", "groups", "spaces", "dashes", "dots", "brackets", "plus", "at", "labels", "luhn", "octets",
            "hint", "letter_before", "digit_before", "space_before", "stop_after", "letter_after", "quoted")


def _features(c: Column) -> list[Column]:
    raw, before, after = c["value"], F.coalesce(c["before"], F.lit("")), F.coalesce(c["after"], F.lit(""))

    area = raw.rlike(_AREA_PHONE)
    v = F.when(area, F.concat(F.lit("+1 "), raw)).otherwise(
        F.regexp_replace(F.regexp_replace(raw, _SPELLED_AT, "@"), _SPELLED_DOT, "."))

    def count(chars):
        return F.char_length(v) - F.char_length(F.translate(v, chars, ""))
    digits = _digits(v)
    flags = [F.char_length(digits), F.char_length(v), F.size(F.split(v, "[^0-9]+")), count(" "), count("-"), count("."),
             count("()"), v.startswith("+"), count("@"), F.size(F.split(F.element_at(F.split(v, "@"), -1), r"\.")),
             _luhn(digits), v.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & _octets(v),
             F.lower(before).rlike(r"(mail|tel|phone|call|fax|card|visa|iban|ip|host|addr|contact)[^a-z]*$"),
             before.rlike(r"\p{L}$"), before.rlike(r"[0-9]$"), before.rlike(r"\s$"), after.rlike(r"^[.,;!?]"),
             after.rlike(r"^\p{L}"), before.rlike("[\"'=]\\s*$")]
    return [f.cast("double").alias(name) for name, f in zip(FEATURES, flags)]


def _kind(value: Column) -> Column:
    return (F.when(value.rlike(r"@|[\[(]at[\])]"), "email").when(value.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip")
            .when(F.char_length(_digits(value)) >= 13, "card").otherwise("phone"))


def _overlaps(s: Column, other: Column) -> Column:
    return (s["start"] < other["end"]) & (other["start"] < s["end"])


def with_candidates(df: DataFrame) -> DataFrame:
    """Add ``_known`` (all base spans) and ``_candidates``: proposed spans with kind, label and features."""
    body = F.col("_plain")
    at = _spans(body, _AT, F.contains(body, F.lit("@")) | body.rlike(r"[\[(]at[\])]"))
    number = _spans(body, _NUMBER, body.rlike(r"[0-9][0-9 ().-]{5}"))
    df = df.withColumn("_known", F.concat(*(F.col(f"_{k}") for k in KINDS))).withColumn("_proposed", F.concat(at, number))
    described = F.transform("_proposed", lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), _kind(c["value"]).alias("kind"),
        (c["value"].rlike(_SPELLED_AT) | c["value"].rlike(_AREA_PHONE)).alias("unseen"), *_features(c)))
    df = df.withColumn("_described", described)
    return df.withColumn("_candidates", F.transform("_described", lambda c: c.withField(
        "label", F.exists("_known", lambda k: _overlaps(c, k)).cast("double"))))


def _trees(text: str) -> list[tuple[float, list[str]]]:
    """Weight and lines of every tree in a model's printed form."""
    out = []
    for line in text.splitlines():
        if head := re.match(r"\s*Tree \d+ \(weight ([-0-9.eE]+)\):", line):
            out.append((float(head[1]), []))
        elif out and line.strip():
            out[-1][1].append(line.strip())
    return out


def _branch(lines: list[str], c: Column) -> Column:
    """The next node of a printed tree as a column; takes its lines off."""
    line = lines.pop(0)
    if leaf := re.match(r"Predict: ([-0-9.eE]+)", line):
        return F.lit(float(leaf[1]))
    feature, bound = re.match(r"If \(feature (\d+) <= ([-0-9.eE]+)\)", line).groups()
    low = _branch(lines, c)
    lines.pop(0)  # Else
    return F.when(c[FEATURES[int(feature)]] <= float(bound), low).otherwise(_branch(lines, c))


class Model:
    """Trees in printed form, and the score from which candidates of a kind are added."""

    def __init__(self, printed: str = "", thresholds: dict[str, float] | None = None):
        self.printed, self.thresholds = printed, thresholds or {}

    def score(self, c: Column) -> Column:
        total = F.lit(0.0)
        for weight, lines in _trees(self.printed):
            total = total + weight * _branch(list(lines), c)
        return total


def fit(docs: DataFrame, text_col: str = "text", precision: float = 0.99, trees: int = 12, depth: int = 3,
        bins: int = 256) -> Model:
    found = with_candidates(with_base(docs.select(F.col(text_col).alias("_text")), "_text"))
    rows = found.select(F.xxhash64("_plain").alias("_h"), F.explode("_candidates").alias("c")).select(
        F.xxhash64("_h", "c.start", "c.end").alias("_h"), "c.*").filter("label = 1 or not unseen")
    # repeated texts give equal candidates; one of each is enough to learn from
    each = rows.dropDuplicates(["_h"]).na.fill(0.0).withColumn("held", F.pmod(F.xxhash64("_h"), F.lit(3)) == 0)
    # candidates that look the same are one row with their number as weight, in a fixed order
    alike = materialize(each.groupBy("kind", "label", "held", *FEATURES).agg(F.count("*").cast("double").alias("weight")),
                        "candidates")
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(
        alike.orderBy("kind", "label", "held", *FEATURES)).select("kind", "label", "vector", "held", "weight").cache()
    try:
        train = table.filter("not held")
        if train.select("label").distinct().count() < 2:
            return Model()
        trained = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth,
                                stepSize=0.3, maxBins=bins, seed=7).fit(train)
        printed = trained.toDebugString
        tried = trained.transform(table.filter("held")).select("kind", "label", "weight", F.expr("rawPrediction").alias("raw"))
        from pyspark.ml.functions import vector_to_array
        tried = tried.select("kind", "label", "weight", (vector_to_array("raw")[1] / 1.0).alias("score"))
        down = Window.partitionBy("kind").orderBy(F.desc("score"))
        runs = tried.groupBy("kind", "score").agg(
            F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n")).select(
            "kind", "score", F.sum("good").over(down).alias("good"), F.sum("n").over(down).alias("n"))
        cut = runs.filter((F.col("good") >= precision * F.col("n")) & (F.col("good") >= 20))
        return Model(printed, {r.kind: r.score for r in cut.groupBy("kind").agg(F.min("score").alias("score")).collect()})
    finally:
        table.unpersist()
        discard(alike)


def _ranked(kind: str) -> Column:
    return F.transform(f"_{kind}", lambda s: F.struct(
        F.lit(KINDS.index(kind)).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def with_spans(docs: DataFrame, text_col: str, model: Model) -> DataFrame:
    """``docs`` with base arrays and ``_all``: base and added spans as (kind, start, end), by kind as listed, then start."""
    df = with_candidates(with_base(docs, text_col))
    known = F.concat(*(_ranked(k) for k in KINDS))
    least = F.create_map(*(F.lit(x) for k, v in model.thresholds.items() for x in (k, v))) if model.thresholds else None
    if least is None:
        return df.withColumn("_all", F.array_sort(known))
    scored = F.filter("_candidates", lambda c: (c["label"] == 0) & (model.score(c) >= least[c["kind"]] - 1e-9))
    df = df.withColumn("_added", scored)
    # a number inside an added address is part of it
    alone = F.filter("_added", lambda c: (c["kind"] == "email") | ~F.exists(
        "_added", lambda o: (o["kind"] == "email") & _overlaps(c, o)))
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    added = F.transform(alone, lambda c: F.struct(
        rank[c["kind"]].alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    return df.withColumn("_all", F.array_sort(F.concat(known, added)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base counts by kind, ``base_sha256`` of the base spans, and all ``spans``."""
    df = with_spans(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", model)
    base = _listed(F.concat(*(_ranked(k) for k in KINDS)))
    return df.select(F.col("_id").alias(id_col), *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
                     F.sha2(base, 256).alias("base_sha256"), _listed(F.col("_all")).alias("spans"))


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in the text replaced by its kind, as ``[email]``; other columns as they are."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    df = with_spans(held, "_text", model)
    by_place = F.array_sort(F.transform("_all", lambda s: F.struct(s["start"], s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substr(F.col("_text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(
            F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).alias("out"))

    new = F.when(F.size("_all") == 0, F.col("_text")).otherwise(F.aggregate(by_place, start, step, lambda a: F.concat(
        a["out"], F.substr(F.col("_text"), a["at"] + 1, F.char_length(F.col("_text"))))))
    out = df.withColumn("_new", new)
    return out.select(*(F.col("_new").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
