"""Personal data by candidate gradient boosting, with DataFrame functions only.

Base rules give the spans that always stay. High-recall generators propose further spans, which may overlap each other
and the base ones. Boosted trees judge the proposals by format and context. They learn what the base rules miss: base
spans of all documents are rewritten, in their own contexts, into forms that only the generators reach (positive) and into
numbers of the same look that are nothing of the kind (negative); proposals that occur in the documents beside the base
spans are negative too. Proposals of equal features are one weighted row, so the trees see all of them. The threshold of
each kind is calibrated on all proposals too: those of each third of the texts are judged by trees that were fitted without
that third. The trees are written out as column expressions, so documents are judged row by row: no span is shuffled, and
no key can be hot.

Spans of a text are gathered in parts of PART, so that the work stays in proportion to their number: no array or text is
copied for each span.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import use_shared_folder

KINDS = ("email", "ip", "card", "phone")
#: Weighted rows that a task of the fit holds, about.
FIT_ROWS = 50_000
#: Parts of the texts; proposals of each are judged, for the thresholds, by trees of the others.
PARTS = 3
#: Share of right proposals that a threshold has to reach.
PRECISION = 0.98
#: Share of the proposals that occur in documents by themselves which a threshold may let pass.
FALSE_SHARE = 0.005
#: Proposals above a threshold that it has to rest on.
LEAST_SUPPORT = 5
#: Spans that are looked at together.
PART = 128

# The base rules. Possessive repeats and look-behind change no match: they keep the scan linear on long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a run of digits parted by single spaces or hyphens, of 16 to 19 digits, from its start to its end
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# The generators of proposals.
PROPOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:@| @ | ?\(at\) ?| ?\[at\] ?)[A-Za-z0-9-]{1,63}(?:(?:\.| \. | ?\(dot\) ?| ?\[dot\] ?)[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9.])[0-9]{1,4}(?: ?\. ?[0-9]{1,4}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ .-]{0,2}[0-9]){12,20}(?![0-9])",
    "phone": r"(?<![0-9])\(?[0-9][ ().0-9/-]{5,24}[0-9](?![0-9])",
}
#: Words that stand before personal data.
CONTEXT = r"(?i)(?:mail|write to|contact|call|tel|phone|mobile|fax|card|visa|account|ip|host|server|address)[^\n]{0,12}$"
#: Code points before and after a span that are its context.
AROUND = 24


SPAN = "struct<s: int, e: int, m: string, before: string, after: string>"
PLACES = "array<struct<s: int, e: int, spans: array<struct<s: int, e: int>>>>"


def _bound(value: Column, use) -> Column:
    """use(value), with the value worked out once, however often and within whatever lambda it is used."""
    return F.transform(F.array(value), use)[0]


def _parted(array: Column) -> Column:
    """The array cut into arrays of PART; an empty array is one empty part."""
    last = lambda x: F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / PART).cast("int")
    return _bound(array, lambda x: F.transform(F.sequence(F.lit(0), last(x)), lambda k: F.slice(x, k * PART + 1, F.lit(PART))))


def _running(values: Column, merge, start: int = 0) -> Column:
    """The merged values before each of a few."""
    return F.aggregate(values, F.struct(F.lit(start).alias("at"), F.array().cast("array<int>").alias("all")), lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])


def spans(text: Column, pattern: str, guard: Column) -> Column:
    """The matches from left to right: start and end in code points, the text, and up to AROUND code points on both sides that are in no match."""
    nothing = F.array().cast(f"array<{SPAN}>")
    gaps = F.split(text, pattern, -1)
    size = lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["hit"]), F.lit(0))

    def step(acc: Column, p: Column) -> Column:
        s = acc["at"] + F.length(p["gap"])
        span = F.struct(s.alias("s"), (s + F.length(p["hit"])).alias("e"), p["hit"].alias("m"), F.right(p["gap"], F.lit(AROUND)).alias("before"), F.left(F.coalesce(p["next"], F.lit("")), F.lit(AROUND)).alias("after"))
        return F.struct((acc["at"] + size(p)).alias("at"), F.when(p["hit"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(span))).alias("found"))

    def gather(parts: Column) -> Column:
        starts = _running(F.transform(parts, lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + size(p))), lambda at, n: at + n)
        each = F.arrays_zip(parts.alias("part"), starts.alias("at"))
        return F.flatten(F.transform(each, lambda z: F.aggregate(z["part"], F.struct(z["at"].alias("at"), nothing.alias("found")), step, lambda acc: acc["found"])))

    found = _bound(gaps, lambda g: _bound(_parted(F.arrays_zip(g.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.slice(g, F.lit(2), F.greatest(F.size(g), F.lit(1))).alias("next"))), gather))
    return F.when(guard & text.rlike(pattern), found).otherwise(nothing)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column) -> Column:
    """Whether all numbers in it are at most 255; leading zeros don't count."""
    return F.forall(F.split(F.regexp_replace(m, "[^0-9.]", ""), r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def _holds(kind: str, m: Column) -> Column:
    """Whether a base match counts."""
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")
    guards = {"email": text.contains("@"), "ip": digit, "card": digit, "phone": text.contains("+")}
    counts = lambda k: lambda x: _holds(k, x["m"])
    return {k: F.filter(spans(text, BASE[k], guards[k]), counts(k)) for k in KINDS}


def proposals(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")
    mail = text.rlike(r"@|\(at\)|\[at\]")
    return {k: spans(text, PROPOSE[k], mail if k == "email" else digit) for k in KINDS}


def _overlaps(x: Column, y: Column) -> Column:
    return (x["s"] < y["e"]) & (y["s"] < x["e"])


def _parted_spans(found: Column) -> Column:
    """Parts of spans with the reach of each part."""
    return F.transform(_parted(found), lambda c: F.struct(F.array_min(F.transform(c, lambda x: x["s"])).alias("s"), F.array_max(F.transform(c, lambda x: x["e"])).alias("e"), c.alias("spans")))


def _meets(parts: Column, x: Column, also=lambda y: F.lit(True)) -> Column:
    """Whether a span of the parts overlaps x; only parts that reach x are looked through."""
    return F.coalesce(F.exists(parts, lambda c: F.when(_overlaps(c, x), F.exists(c["spans"], lambda y: _overlaps(y, x) & also(y))).otherwise(F.lit(False))), F.lit(False))


FEATURES = ("kind", "length", "digits", "letters", "spaces", "dots", "hyphens", "brackets", "luhn", "octets", "longest", "touches", "named")


def features(kind: str, span: Column) -> list[Column]:
    m, before, after = span["m"], span["before"], span["after"]
    count = lambda p: F.length(F.regexp_replace(m, p, "")).cast("double")
    runs = F.array_max(F.transform(F.split(m, "[^0-9]+"), lambda p: F.length(p)))
    found = {
        "kind": F.lit(float(KINDS.index(kind))),
        "length": F.length(m).cast("double"),
        "digits": count("[^0-9]"),
        "letters": count("[^A-Za-z]"),
        "spaces": count("[^ ]"),
        "dots": count("[^.]"),
        "hyphens": count("[^-]"),
        "brackets": count(r"[^()\[\]]"),
        "luhn": F.coalesce(F.call_function("luhn_check", _digits(m)), F.lit(False)).cast("double"),
        "octets": _octets(m).cast("double"),
        "longest": F.coalesce(runs, F.lit(0)).cast("double"),
        "touches": (before.rlike(r"[\p{L}\p{N}=/_.+-]$").cast("int") + after.rlike(r"^[\p{L}\p{N}=/_@-]").cast("int")).cast("double"),
        "named": before.rlike(CONTEXT).cast("double"),
    }
    return [found[f].alias(f) for f in FEATURES]


def _tree(lines: list[str], values: list[Column]) -> Column:
    """A tree of the library's printout as an expression; takes its lines off the list."""
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return F.lit(float(line.split(":")[1]))
    feature, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _tree(lines, values)
    lines.pop(0)  # the matching Else
    return F.when(values[int(feature)] <= float(bound), low).otherwise(_tree(lines, values))


def probability(model: dict, values: list[Column]) -> Column:
    """The boosted trees' probability for the features."""
    margin = reduce(lambda a, b: a + b, [F.lit(w) * _tree(list(lines), values) for w, lines in model["trees"]])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def _printed(model: GBTClassificationModel) -> list[tuple[float, list[str]]]:
    found: list[tuple[float, list[str]]] = []
    for line in model.toDebugString.split("\n"):
        if m := re.match(r"\s*Tree \d+ \(weight ([-\d.eE]+)\)", line):
            found.append((float(m[1]), []))
        elif found and line.strip():
            found[-1][1].append(line)
    return found


def _rewritten(kind: Column, m: Column) -> Column:
    """Forms of a base span as (form, of, right): the kind that it should pass for, and whether it is one."""
    form = lambda of, right, *texts: [F.struct(t.alias("form"), F.lit(of).alias("of"), F.lit(right).alias("right")) for t in texts]
    local, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    swap = lambda x, by: F.replace(x, F.lit("."), F.lit(by))
    mail = form("email", 1.0, F.concat(local, F.lit(" (at) "), swap(host, " (dot) ")), F.concat(local, F.lit("[at]"), swap(host, "[dot]")), F.concat(local, F.lit(" @ "), swap(host, " . ")), F.concat(local, F.lit("(at)"), host))
    octet = lambda k: F.element_at(F.split(m, r"\."), k)
    large = F.concat(F.lit("3"), F.lpad(F.right(octet(1), F.lit(2)), 2, "0"), F.lit("."), octet(2), F.lit("."), octet(3), F.lit("."), octet(4))
    ip = form("ip", 1.0, swap(m, " . "), swap(m, ". ")) + form("ip", 0.0, swap(large, " . "), swap(large, ". "), large)
    ip += form("email", 0.0, F.concat(octet(1), F.lit(" @ "), octet(2), F.lit("."), octet(3)))  # a price
    digits = _digits(m)
    # one more in the last digit, so that the check digit is wrong
    other = F.concat(F.left(digits, F.length(digits) - 1), F.translate(F.right(digits, F.lit(1)), "0123456789", "1234567890"))
    grouped = lambda d, by: F.regexp_replace(d, "([0-9]{4})(?=[0-9])", f"$1{by}")
    card = form("card", 1.0, grouped(digits, "."), grouped(digits, "  "), grouped(digits, "--")) + form("card", 0.0, grouped(other, "."), grouped(other, "  "), grouped(other, "-"), other)
    near = F.right(digits, F.lit(10))
    cut = lambda k, n: F.substring(near, k, n)
    phone = form("phone", 1.0, F.substring(m, 2, 1000), F.concat(F.lit("("), cut(1, 3), F.lit(") "), cut(4, 3), F.lit("-"), cut(7, 4)), F.concat_ws(".", cut(1, 3), cut(4, 3), cut(7, 4)))
    # dates, years, a bare number, digits of a longer word
    phone += form("phone", 0.0, F.concat(F.lit("20"), cut(1, 2), F.lit("-0"), cut(3, 1), F.lit("-1"), cut(4, 1)), F.concat(F.lit("1"), cut(1, 1), F.lit("/0"), cut(2, 1), F.lit("/20"), cut(3, 2)), F.concat(F.lit("19"), cut(1, 2), F.lit("-19"), cut(3, 2)), cut(1, 8), F.concat(F.lit("f"), near, F.lit("b6")), F.concat(F.lit("7e"), cut(1, 7), F.lit("d")))
    return F.when(kind == "email", F.array(*mail)).when(kind == "ip", F.array(*ip)).when(kind == "card", F.array(*card)).otherwise(F.array(*phone))


def _proposed(text: Column, label) -> Column:
    """The proposals in a text as (of, label, features); without those whose label is null."""
    each = lambda k: lambda x: F.struct(F.lit(k).alias("of"), label(k, x).alias("label"), *features(k, x))
    return F.filter(F.concat(*[F.transform(p, each(k)) for k, p in proposals(text).items()]), lambda x: x["label"].isNotNull())


def _judged(documents: DataFrame, text: str) -> DataFrame:
    """The proposals that are learned from, as weighted rows: of, part, own (whether it occurs in a document as it is), label, features and n.

    n is the number of such proposals. A text that repeats counts once: rows of its copies agree in the text's digest and
    their places, and only these are shuffled, never the text.
    """
    t = F.col("t")
    source = documents.select(F.col(text).alias("t")).where("t is not null and t rlike '[0-9@]|\\\\(at\\\\)|\\\\[at\\\\]'")
    named = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), *[x[f].alias(f) for f in ("s", "e", "m", "before", "after")])
    base = F.concat(*[F.transform(c, named(k)) for k, c in base_spans(t).items()])
    based = source.select("t", F.md5(t.cast("binary")).alias("digest"), F.pmod(F.xxhash64("t", F.lit(3)), F.lit(PARTS)).alias("part"), base.alias("base"))

    # what proposals are looked for in: the text with its base spans, and each form in its context with its own place
    places = _parted_spans(F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"))))
    piece = lambda t, parts, of, right, s, e: F.struct(t.alias("t"), parts.cast(PLACES).alias("parts"), of.cast("string").alias("of"), right.cast("double").alias("right"), s.cast("int").alias("s"), e.cast("int").alias("e"))
    none = F.lit(None)
    form = lambda b: lambda f: piece(F.concat(b["before"], f["form"], b["after"]), none, f["of"], f["right"], F.length(b["before"]), F.length(b["before"]) + F.length(f["form"]))
    forms = F.flatten(F.transform("base", lambda b: F.transform(_rewritten(b["kind"], b["m"]), form(b))))
    # the outer explode: for the inner one, the optimizer would work the whole array out a second time, to see if it is empty
    pieces = based.select("digest", "part", F.posexplode_outer(F.concat(F.array(piece(t, places, none, none, none, none)), forms)).alias("i", "p"))

    own, place = F.col("p.of").isNull(), F.struct(F.col("p.s").alias("s"), F.col("p.e").alias("e"))
    whole = lambda x: (F.abs(x["s"] - place["s"]) <= 1) & (F.abs(x["e"] - place["e"]) <= 1)
    beside = lambda x: F.when(~_meets(F.col("p.parts"), x), 0.0)
    made = lambda k, x: F.when(_overlaps(x, place), F.when((F.col("p.of") == k) & whole(x), F.col("p.right")).otherwise(0.0))
    label = lambda k, x: F.when(own, beside(x)).otherwise(made(k, x))
    each = pieces.select("digest", "part", own.alias("own"), "i", F.posexplode_outer(_proposed(F.col("p.t"), label)).alias("j", "x")).where("x is not null")
    once = each.select("digest", "part", "own", "i", "j", "x.*").distinct()
    return once.groupBy("of", "part", "own", "label", *FEATURES).agg(F.count("*").alias("n"))


def _fitted(rows: DataFrame, trees: int, depth: int) -> list[tuple[float, list[str]]]:
    """Trees (weight and printout) fitted on all the weighted rows; none without rows of both labels."""
    learned = rows.groupBy("label", *FEATURES).agg(F.sum("n").cast("double").alias("weight"))
    labels = {r["label"]: r["count"] for r in learned.groupBy("label").count().collect()}
    if set(labels) != {0.0, 1.0}:
        return []
    n = sum(labels.values())
    # in a fixed order: splits of equal gain are told apart by the rounding of sums
    learned = learned.coalesce(1 + n // FIT_ROWS).sortWithinPartitions(*FEATURES, "label")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(learned)
    # the library looks for splits in a sample of max(10,000, bins squared) rows, so that many bins make it look at all of them
    bins = max(32, math.isqrt(n) + 1)
    return _printed(GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11, maxBins=bins).fit(vectors))


def train_pii_model(documents: DataFrame, text: str = "text", trees: int = 16, depth: int = 4, precision: float = PRECISION) -> dict:
    """trees (weight and printout), the threshold of each kind, and measured: proposals above it and right ones, of those judged.

    A kind without a threshold gets no spans added. The proposals of all documents give the trees and the thresholds: for
    these, the proposals of each part of the texts are judged by trees of the other parts. A text that repeats counts once.
    Without proposals of both labels there are no trees, and the base rules stand alone; proposals of a part are not judged
    if the other parts lack a label.
    """
    use_shared_folder(documents.sparkSession)
    rows = _judged(documents, text).checkpoint()
    model = {"trees": _fitted(rows, trees, depth), "thresholds": {}, "measured": {}}
    if not model["trees"]:
        return model
    seen = []
    for part in range(PARTS):
        others = {"trees": _fitted(rows.where(F.col("part") != part), trees, depth)}
        if others["trees"]:
            judged = rows.where(F.col("part") == part).select("of", "own", "label", "n", F.floor(probability(others, [F.col(f) for f in FEATURES]) * 50).cast("int").alias("step"))
            seen += judged.groupBy("of", "own", "step").agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("right")).collect()
    for k in KINDS:
        mine = [r for r in seen if r["of"] == k]
        own = sum(r["n"] for r in mine if r["own"])
        for step in range(25, 51):
            above = [r for r in mine if r["step"] >= step]
            total, right = sum(r["n"] for r in above), sum(r["right"] for r in above)
            if total >= LEAST_SUPPORT and right / total >= precision and sum(r["n"] for r in above if r["own"]) <= FALSE_SHARE * own:
                model["thresholds"][k] = step / 50
                model["measured"][k] = {"above": total, "right": int(right), "all_right": int(sum(r["right"] for r in mine))}
                break
    return model


def find_pii(documents: DataFrame, model: dict, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, base and found of each document: arrays of (kind, s, e) in code points, end exclusive; and the columns to carry as carried_<n>.

    base has the spans of the base rules by kind, then start; found has these and what the model adds. An addition never
    overlaps a base span, and of additions that overlap the likelier stays, of equally likely ones the kind that is listed
    first. Null and empty texts have none. Repeated rows give a row each, null keys are kept, an empty table gives no rows.
    Other columns are ignored.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *[F.col(f"`{c}`").alias(f"carried_{n}") for n, c in enumerate(carry)])
    kept = rows.columns
    thresholds = model["thresholds"] if model["trees"] else {}
    named = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
    base = F.concat(*[F.transform(c, named(k)) for k, c in base_spans(t).items()])
    if not thresholds:
        return rows.select(*kept, base.alias("base")).select("*", F.col("base").alias("found"))

    def likely(k: str, proposed: Column, parts: Column) -> Column:
        """Proposals of the kind apart from the base spans, with their probability."""
        free = F.filter(proposed, lambda x: ~_meets(parts, x))
        seen = F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), *features(k, x)))
        judged = F.transform(seen, lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), probability(model, [x[f] for f in FEATURES]).alias("p")))
        return F.filter(judged, lambda x: x["p"] >= thresholds[k])

    more = {k: p for k, p in proposals(t).items() if k in thresholds}
    added = lambda b: _bound(_parted_spans(b), lambda parts: F.concat(*[likely(k, p, parts) for k, p in more.items()]))
    rows = rows.select(*kept, base.alias("base")).select(*kept, "base", added(F.col("base")).alias("added"))
    first = lambda x, y: (y["p"] > x["p"]) | ((y["p"] == x["p"]) & (F.array_position(F.lit(list(KINDS)), y["kind"]) < F.array_position(F.lit(list(KINDS)), x["kind"])))
    apart = lambda a: _bound(_parted_spans(F.array_sort(F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["p"].alias("p"))))), lambda parts: F.filter(a, lambda x: ~_meets(parts, x, lambda y: first(x, y))))
    every = F.concat("base", F.transform(apart(F.col("added")), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    of_kind = lambda k: lambda x: x["kind"] == k
    ordered = _bound(every, lambda e: F.concat(*[F.array_sort(F.filter(e, of_kind(k))) for k in KINDS]))
    return rows.select(*kept, "base", F.when(F.size("added") > 0, ordered).otherwise(F.col("base")).alias("found"))


def joined(found: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(found: DataFrame) -> DataFrame:
    """The columns of `found` less base and found, and text, in which [EMAIL], [IP], [CARD] or [PHONE] stands for each found span.

    Overlapping spans are one, named by the first; of spans that begin together the longest is first. A null text stays
    null, a text without spans stays as it is, and repeated rows give a row each.
    """
    t = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        """`part` is the text from `from` on; `at` is where the text goes on that isn't written yet."""
        before = F.concat(acc["out"], F.substring(acc["part"], acc["at"] - acc["from"] + 1, x["s"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        now = lambda at, out: F.struct(acc["part"].alias("part"), acc["from"].alias("from"), at.alias("at"), out.alias("out"))
        return F.when(x["s"] < acc["at"], now(F.greatest(x["e"], acc["at"]), acc["out"])).otherwise(now(x["e"], before))

    def rebuilt(parts: Column) -> Column:
        ends = F.transform(parts, lambda c: F.array_max(F.transform(c, lambda x: x["e"])))
        last = lambda z: F.element_at(z["spans"], -1)["s"]
        start = lambda z: F.struct(F.substring(t, z["at"] + 1, F.greatest(last(z) - z["at"], F.lit(0))).alias("part"), z["at"].alias("from"), z["at"].alias("at"), F.lit("").alias("out"))
        each = F.arrays_zip(parts.alias("spans"), _running(ends, F.greatest).alias("at"))
        pieces = F.transform(each, lambda z: F.aggregate(z["spans"], start(z), step, lambda acc: acc["out"]))
        return F.concat(F.array_join(pieces, ""), F.substring(t, F.array_max(ends) + 1, F.length(t)))

    order = F.array_sort(F.transform("found", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return found.withColumn("text", F.when(F.size("found") > 0, _bound(_parted(order), rebuilt)).otherwise(t)).drop("base", "found")
