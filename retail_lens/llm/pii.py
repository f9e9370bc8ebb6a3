"""Personal data: patterns propose spans, boosted trees score them by format and context, a threshold of each kind selects redactions.

All of it runs as built-in expressions inside one projection of the documents: no Python, no explode and no shuffle of texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .fingerprint import let

#: In the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
# The base patterns. Loops are possessive, so that matching neither backtracks nor recurses, and a look-behind
# starts a match only where a run of its first characters starts, or the previous match ended: neither changes what matches.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs at least for a pattern to match; cheaper than the pattern.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
#: High-recall generators besides the base: (kind, pattern, what a text needs at least). Their spans may overlap each other.
WIDER = (
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\s?(?:\(at\)|\[at\])\s?[a-z0-9-]++(?:\s?(?:\(dot\)|\[dot\]|\.)\s?[a-z0-9-]++)++", r"(?i)[(\[]at[)\]]"),
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\s@\s[a-z0-9-]++(?:\s?\.\s?[a-z0-9-]++)++", r"\s@\s"),
    ("ip", r"(?i)(?<![0-9a-z:])[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}(?![0-9a-z:])", r"(?i)[0-9a-f]:[0-9a-f]{1,4}:[0-9a-f]{1,4}:[0-9a-f]{1,4}:[0-9a-f]"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])", NEEDS["card"]),
    ("card", r"(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])", NEEDS["card"]),
    ("phone", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"),
    ("phone", r"(?<![0-9.])00[1-9][0-9]{0,2}(?:[\x20./-]?[0-9]){7,10}(?![0-9])", r"00[1-9][0-9\x20./-]{7}"),
    # addresses in words, shortened IPv6 addresses, area codes in brackets without a gap, and national numbers
    ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\sat\s[a-z0-9-]++(?:\sdot\s[a-z0-9-]++)++", r"(?i)\sat\s[a-z0-9-]++\sdot\s"),
    ("ip", r"(?i)(?<![0-9a-z:])(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6}::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?|::[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})(?![0-9a-z:])", r"(?i)[0-9a-f]::|::[0-9a-f]"),
    ("phone", r"(?<![0-9+])\([0-9]{3}\)[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])", r"\([0-9]{3}\)[0-9]{3}"),
    ("phone", r"(?<![0-9+.,-])0[1-9][0-9]{1,3}[\x20/-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", r"0[1-9][0-9]{1,3}[\x20/-][0-9]{3}"),
)
#: Characters of context on either side, and words in them that speak for each kind, or for a number of another sort.
CONTEXT = 24
HINTS = {"email": "mail|contact|write|reach|address", "ip": r"\bip\b|ipv6|addr|host|server|ping|subnet", "card": "card|visa|master|amex|payment|paid|charge", "phone": r"phone|\btel|\bcall|\bfax|mobile|ring|dial|cell"}
AGAINST = r"order|invoice|isbn|issn|\bref|part|serial|version|build|sku|\bitem|ticket|track|batch|model|\bcase|page|hash|\bmac\b|digest|checksum|meet|price|score"
FEATURES = ("kind", "chars", "digits", "separators", "groups", "first", "bracket", "hint", "against", "spaced", "closed")
#: Injected values in each kind's formats (# a digit, ~ a word, ^ a hexadecimal digit): personal data, and what only looks like it.
WORDS = ("ann", "lee", "shop", "home", "christina", "north", "office", "x", "we", "garden", "mailbox", "berlin", "the", "noon", "marketing", "jo")
FORMATS = {
    "email": (("~ (at) ~ (dot) com", "~.~ [at] ~ [dot] org", "~(at)~.net", "~## @ ~.de", "~ [at] ~ . co . uk", "~ (at) ~.~.edu", "~ @ ~ . info", "~ at ~ dot com", "~.~ at ~ dot org", "~## at ~ dot co dot uk"), ("~ at ## dot ##", "# at ## dot #", "~ at # dot ~", "~ (at) ##.##", "~ (at) # . #", "~ @ # . ##", "~ @ ##.##", "~ [at] ~. ~", "~ (at) ~. ~", "~ @ ~. ~")),
    "ip": (("2001:^^^^:^^^^:^:^^^:^^^^:^^^^:^^^^", "fe80:0:0:0:^^^^:^^^^:^^^^:^^^^", "2a02:^^^^:^^^:^^^^:^^^^:^^^^:^^^:^^^^", "2001:^^^::#", "fe80::^^^^:^^^:^^^^:^^^^", "2a02:^^^^:^^^^::^^^:#", "2001:^^^^:#::^^^^"), ("#::#", "##::##", "a::b", "^^::^^", "::#", "^^:^^:^^:^^:^^:^^:^^:^^", "#:#:#:#:#:#:#:#", "##:##:##:##:##:##:##:##")),
    "card": (("4### #### #### ####", "5###-####-####-####", "4###############", "37## ###### #####", "6011 #### #### ####"), ("0### #### #### ####", "9###-####-####-####", "1###############", "8### #### #### ####", "2### #### #### ####")),
    "phone": (("(###) ###-####", "###-###-####", "### ### ####", "###.###.####", "0049 ## #######", "0044 #### ######", "(###)###-####", "(###)#######", "020 #### ####", "01## ### ####", "07### ######", "030 #######", "04#/### ####"), ("01# ### ###", "0## ### ####", "0##-####-###", "0###/### ###", "###-###-####", "### ### ####", "000-###-####", "001########", "###.###.####", "00########", "00##############", "00############")),
}
#: Phrases before the values. A third of them, and the values in them, are held out.
PHRASES = {
    "email": (("write to", "e-mail:", "reach me at", "contact", "my address is", "mail", "questions go to", ""), ("we meet", "score", "room", "price", "the game ended", "page", "lunch", "")),
    "ip": (("ping", "server", "host", "from address", "IPv6", "connected to", "my ip is", ""), ("mac", "checksum", "digest", "hash", "times", "case", "ratio", "")),
    "card": (("card", "pay with Visa", "charged to", "paid by", "payment card no.", "amex", "my card is", ""), ("order", "tracking", "invoice", "serial", "ISBN", "sku", "batch", "")),
    "phone": (("call", "phone:", "tel.", "fax", "ring me on", "mobile", "my number is", "dial", ""), ("order", "part", "ISBN", "ticket", "ref.", "serial no.", "version", "model", "")),
}
#: Injected spans that the trees are fitted and calibrated on, and documents whose words stand around them.
FIT_ROWS, FIT_DOCS = 8000, 500
#: The share of personal data that a threshold must leave among what it selects, and the held-out spans that it needs to be told.
PRECISION, LEAST_ROWS = 0.98, 25


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the checksum of a string of digits holds."""
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + F.lit(1), F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def holds(kind: str, span: Column) -> Column:
    """Whether a match of the base pattern is personal data by itself."""
    n = F.length(_digits(span))
    return {
        "email": F.lit(True),
        "ip": span.rlike(r"\A(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|\z)){4}\z"),
        "card": F.when(n.between(12, 19), luhn(_digits(span))).otherwise(False),
        "phone": n.between(9, 15),
    }[kind]


def matches(text: Column, pattern: str, needs: str, body) -> Column:
    """Array of ``body(start, span)`` of the leftmost non-overlapping matches; start counts code points.

    A start is the summed length of the gaps up to a match and of the matches before it.
    """
    def placed(pair: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,span:string>>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(pair["gaps"], i))
            span = F.get(pair["spans"], i)
            return F.struct((start + F.length(span)).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), span.alias("span")))).alias("out"))

        out = F.aggregate(F.sequence(F.lit(0), F.size(pair["spans"]) - 1), first, step, lambda acc: acc["out"])
        return F.when(F.size(pair["spans"]) > 0, out).otherwise(F.array().cast("array<struct<start:int,span:string>>"))

    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("spans"), F.split(text, pattern, -1).alias("gaps"))
    found = F.when(text.rlike(needs), let(pair, placed)).otherwise(F.array().cast("array<struct<start:int,span:string>>"))
    return F.transform(found, lambda m: body(m["start"], m["span"]))


def candidates(text: Column) -> Column:
    """All proposed spans of a text, overlapping ones too: start, order (its kind's place in KINDS), stop, base, and the features.

    A proposal of a wider generator that meets a base span adds nothing to it, and a card whose checksum fails is none: both are left out.
    """
    def described(kind: str, base: bool):
        def body(start: Column, span: Column) -> Column:
            stop = start + F.length(span)
            before = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
            after = F.substring(text, stop + 1, F.lit(CONTEXT))
            around = F.lower(F.concat(before, F.lit("\n"), after))
            features = {
                "kind": F.lit(float(KINDS.index(kind))), "chars": F.length(span), "digits": F.length(_digits(span)), "separators": F.length(F.regexp_replace(span, "[A-Za-z0-9]", "")),
                "groups": F.size(F.split(span, "[^A-Za-z0-9]+")), "first": F.coalesce(F.substring(_digits(span), 1, 1).try_cast("int"), F.lit(-1)), "bracket": span.rlike(r"\(|\[").cast("int"), "hint": around.rlike(HINTS[kind]).cast("int"),
                "against": around.rlike(AGAINST).cast("int"), "spaced": before.rlike(r"(?:\A|\s)\z").cast("int"), "closed": after.rlike(r"\A[\s.,;)]|\A\z").cast("int"),
            }
            return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("order"), stop.alias("stop"), (holds(kind, span) if base else F.lit(False)).alias("base"), (holds(kind, span) if kind == "card" and not base else F.lit(not base)).alias("wide"), *(features[f].cast("double").alias(f) for f in FEATURES))

        return body

    found = [matches(text, BASE[k], NEEDS[k], described(k, True)) for k in KINDS] + [matches(text, pattern, needs, described(k, False)) for k, pattern, needs in WIDER]
    free = lambda every: F.filter(every, lambda c: c["base"] | c["wide"] & ~F.exists(every, lambda b: b["base"] & (b["start"] < c["stop"]) & (c["start"] < b["stop"])))
    return let(F.concat(*found), free)


class Trees:
    """Boosted trees as a column expression, the margin of each kind from which a proposal is selected (a kind without one: none is),
    and report: by kind the precision and recall of that on held-out injected spans."""

    def __init__(self, trees: list[tuple[float, object]], thresholds: dict[str, float] | None, report: dict[str, tuple[float, float, int]] | None = None):
        self.trees, self.thresholds, self.report = trees, thresholds or {}, report or {}

    def margin(self, c: Column) -> Column:
        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, cut, left, right = node
            return F.when(c[FEATURES[feature]] <= F.lit(cut), value(left)).otherwise(value(right))

        return reduce(lambda a, b: a + b, (F.lit(w) * value(t) for w, t in self.trees))

    def over(self, c: Column) -> Column:
        """How far a proposal is over its kind's threshold; null for kinds without one."""
        if not self.thresholds:
            return F.lit(None).cast("double")
        least = reduce(lambda out, k: F.when(c["order"] == KINDS.index(k), F.lit(self.thresholds[k])).otherwise(out), self.thresholds, F.lit(None).cast("double"))
        return self.margin(c) - least


def _node(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    split = node.split()
    return split.featureIndex(), split.threshold(), _node(node.leftChild()), _node(node.rightChild())


def _filled(form: Column) -> Column:
    """A format with its signs replaced by digits and words that a hash of (id, place) draws."""
    draw = lambda i, n: F.pmod(F.xxhash64("id", i, F.lit("sign")), F.lit(n)).cast("int")
    one = lambda c, i: F.when(c == "#", draw(i, 10).cast("string")).when(c == "~", F.get(F.array(*(F.lit(w) for w in WORDS)), draw(i, len(WORDS)))).when(c == "^", F.substring(F.lit("0123456789abcdef"), draw(i, 16) + 1, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(form, ""), one), "")


def _checked(span: Column) -> Column:
    """A number whose last digit makes its checksum hold."""
    head = F.substring(span, F.lit(1), F.length(span) - 1)
    ways = F.transform(F.array(*(F.lit(str(d)) for d in range(10))), lambda d: F.concat(head, d))
    return F.get(F.filter(ways, lambda w: luhn(_digits(w))), F.lit(0))


def injected(docs: DataFrame, text: str = "text", key: str = "doc_id", fit_rows: int = FIT_ROWS, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(text, start, stop, order, label, held): ``fit_rows`` values put between words of the corpus, half of them personal data, in varied formats and phrases.

    Words around a value come from about ``fit_docs`` documents, chosen by a hash of ``key``; of each only a few words are used, and
    none are if there are no documents.
    """
    spark = docs.sparkSession
    chosen = common.hash_sample(docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("t is not null"), "k", fit_docs, "pii-context")
    words = F.filter(F.split("t", r"\s+"), lambda w: w.rlike(r"\A\p{L}{1,20}[.,]?\z"))
    around = [r[0] for r in chosen.select(F.array_join(F.slice(words, 1, 6), " ").alias("w")).where("w <> ''").orderBy("w").limit(2 * fit_docs).collect()] or [""]
    by_kind = lambda lists: reduce(lambda out, k: F.when(F.col("order") == KINDS.index(k), F.when(F.col("label") == 1, F.array(*(F.lit(x) for x in lists[k][0]))).otherwise(F.array(*(F.lit(x) for x in lists[k][1])))).otherwise(out), KINDS[1:], F.when(F.col("label") == 1, F.array(*(F.lit(x) for x in lists["email"][0]))).otherwise(F.array(*(F.lit(x) for x in lists["email"][1]))))
    draw = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    rows = spark.range(fit_rows).select("id", (F.col("id") % len(KINDS)).cast("int").alias("order"), F.expr(f"id div {len(KINDS)} % 2").cast("double").alias("label"))
    rows = rows.withColumns({"phrases": by_kind(PHRASES), "formats": by_kind(FORMATS)})
    rows = rows.withColumns({"nth": draw("phrase", F.size("phrases")), "span": _filled(F.get("formats", draw("format", F.size("formats"))))})
    rows = rows.withColumn("span", F.when(F.col("order") == KINDS.index("card"), _checked(F.col("span"))).otherwise(F.trim("span")))
    words = F.array(*(F.lit(x) for x in around))
    before = F.concat_ws(" ", F.get(words, draw("before", F.lit(len(around)))), F.nullif(F.get("phrases", "nth"), F.lit("")), F.lit(""))
    # a card by itself is a base span; what a generator adds are cards that run on into other digits
    rows = rows.withColumn("more", F.when(F.col("order") == KINDS.index("card"), _filled(F.lit(" ###"))).otherwise(""))
    second = F.when((F.col("order") == KINDS.index("card")) & (draw("second", F.lit(2)) == 0), F.concat(_filled(F.lit("4### #### #### ####")), F.lit(" "))).otherwise("")
    rows = rows.select("order", "label", (F.col("nth") % 3 == 0).alias("held"), "span", "more", F.concat(before, second).alias("before"), F.get(words, draw("after", F.lit(len(around)))).alias("after"))
    return rows.select(F.concat("before", "span", "more", F.lit(" "), "after").alias("text"), F.length("before").alias("start"), (F.length("before") + F.length("span")).alias("stop"), "order", "label", "held")


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> Trees:
    """Trees that tell personal data from look-alikes among the proposals of the wider generators.

    They learn from ``injected`` spans, so there are as many labelled rows however rare personal data is in the corpus, and the base
    check labels none of them. On the spans of held-out phrases each kind's threshold is set: the least margin from which on at least
    PRECISION of what is selected is personal data. A kind with under LEAST_ROWS of either class, or no such margin, has none.
    """
    made = common.materialize(injected(docs, text, key, fit_rows), "pii-injected")
    c = F.explode(candidates(F.col("text"))).alias("c")
    met = made.select("order", "label", "held", "start", "stop", c).where("c.wide and c.order = `order` and c.start < stop and start < c.stop")
    rows = common.materialize(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(met.select("order", "label", "held", *(f"c.{f}" for f in FEATURES))).select("order", "label", "held", "features"), "pii-sample")
    model = GBTClassifier(maxIter=10, maxDepth=4, stepSize=0.3, seed=7).fit(rows.where("not held").coalesce(1))
    trees = [(w, _node(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees, strict=True)]
    # a raw prediction is the margin once against and once for
    scored = model.transform(rows.where("held")).select("order", (vector_to_array("rawPrediction")[1] / 2).alias("m"), "label").collect()
    thresholds, report = {}, {}
    for n, kind in enumerate(KINDS):
        margins = sorted(((r["m"], r["label"]) for r in scored if r["order"] == n), reverse=True)
        whole = sum(label for _, label in margins)
        if min(whole, len(margins) - whole) < LEAST_ROWS:
            continue
        good = 0.0
        for i, (m, label) in enumerate(margins, 1):
            good += label
            if (i == len(margins) or margins[i][0] < m) and good / i >= PRECISION:
                thresholds[kind], report[kind] = m, (good / i, good / whole, i)
    # a margin as the trees' columns sum it up may differ from the model's in its last bits
    return Trees(trees, {k: m - 1e-9 for k, m in thresholds.items()}, report)


def find_spans(text: Column, trees: Trees) -> Column:
    """Sorted array of (start, order, stop, base): the base spans, and the proposals that the trees select. Of selected proposals that
    overlap, that with the highest margin over its threshold stays (then the first, then the longest). Null and empty texts have none."""
    scored = F.transform(candidates(F.coalesce(text, F.lit(""))), lambda c: F.struct(c["start"].alias("start"), c["order"].alias("order"), c["stop"].alias("stop"), c["base"].alias("base"), trees.over(c).alias("over")))
    chosen = F.filter(scored, lambda c: c["base"] | F.coalesce(c["over"] >= 0, F.lit(False)))

    def best(every: Column) -> Column:
        rank = lambda c: F.struct(c["over"], -c["start"], c["stop"], -c["order"])
        return F.filter(every, lambda c: c["base"] | ~F.exists(every, lambda b: ~b["base"] & (b["start"] < c["stop"]) & (c["start"] < b["stop"]) & (rank(b) > rank(c))))

    return F.sort_array(F.array_distinct(F.transform(let(chosen, best), lambda c: F.struct(c["start"].alias("start"), c["order"].alias("order"), c["stop"].alias("stop"), c["base"].alias("base")))))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; spans that overlap go together, under the first one's kind.

    Null and empty texts, and texts without spans, stay as they are; all rows and columns stay.
    """
    t = F.col(text)
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(t, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(gap, F.get(kinds, s["order"])))).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    cleaned = let(find_spans(t, trees), lambda spans: F.when(F.size(spans) == 0, t).otherwise(F.aggregate(spans, first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))))))
    return docs.withColumn(text, cleaned)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", find_spans(F.col("text"), fit(docs)).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["order"])
    counts = [F.size(F.filter(kinds, lambda k: k == n)).cast("long").alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
