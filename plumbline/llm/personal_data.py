r"""Personal data: generators propose overlapping spans, boosted trees on format and context select among them.

DataFrame operations only. A generator is a regular expression. Spark has no function that gives the places of all
matches, but the pieces that `split` leaves between them have lengths, and so have the matches: their running sums over
a document are the offsets, and the ends of the pieces are the context. Expressions are written so that no start is
tried twice and no repetition recurses, whatever the length of a text.

Four generators are the fixed formats; a match that passes its check is a base span and stays. Wider generators propose
what those miss: numbers written right behind one another, national phone numbers, bare card numbers, masked addresses.
Their proposals are scored by gradient-boosted trees over format features (digits, length, separators, Luhn sum, issuer
digit, brackets) and context features (neighbouring characters, words before). The trees are fitted on labelled example
sentences that are made here, LABELLED of them and a tenth more of look-alikes of addresses, and read through the same generators; a third of them calibrates the
score to a probability and sets, for each kind, the lowest threshold with the wanted precision. The trees run as
CASE expressions. Of the selected proposals that overlap no base span, taken by start and the longer first, each that
does not overlap the last one taken is listed.

Defined results: null text is empty; rows without a span have counts of 0, the digest of the empty string and empty
spans; repeated rows and null doc_ids are rows of their own; an empty table gives no rows. Offsets are code points, end
exclusive. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boosting

KINDS = ("email", "ip", "card", "phone")
#: Example sentences for the trees, and the precision that a threshold must reach on those kept for calibration.
LABELLED, PRECISION = 1500, 0.98
CONTEXT = 30


@dataclass(frozen=True)
class Generator:
    kind: str
    pattern: str
    #: A cheap test that every text with a match passes.
    hint: str
    base: bool


_LOCAL = "A-Za-z0-9._%+-"
_CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
GENERATORS = (
    Generator("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True),
    Generator("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", True),
    # Runs of digits with single separators, from their start; those with under 16 digits are passed over.
    Generator("card", rf"(?<![0-9])(?<![0-9][\x20-])(?=[0-9](?:[\x20-]?[0-9]){{15}}){_CARD}", "[0-9](?:[ -]?[0-9]){15}", True),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", True),
    # A blank may follow a plain dot only where one comes before it: ". word" begins another sentence.
    Generator("email", rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{{1,63}}(?:(?:\.|\x20\.\x20?|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]{{1,63}}){{1,8}}", r"[\[(] ?at ?[\])]", False),
    Generator("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])", "[0-9]{4}", False),
    Generator("phone", r"(?<![0-9+])(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", "[0-9]{4}", False),
)

_WANTED = r"(?i)(phone|tel|call|mobile|fax|dial|card|visa|credit|paid|pay|mail|contact|reach|write)[^A-Za-z]*\w{0,8}[^A-Za-z]*$"
_OTHER = r"(?i)(isbn|order|ref|invoice|serial|part|model|version|ticket|id|no|build|time|stamp|sku|batch)[^A-Za-z]*$"
FEATURES = ("kind", "digits", "chars", "breaks", "luhn", "lead", "plus", "bracket", "before", "after", "wanted", "other", "variety")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum of at most 19 digits is a multiple of ten."""
    figure = F.split(F.reverse(digits), "")
    doubled = F.transform(figure, lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + (d.cast("int") * 2 / 10).cast("int")))
    return F.when(F.length(digits).between(1, 19), F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0).otherwise(F.lit(False))


def candidates(docs: DataFrame) -> DataFrame:
    """A row per proposal, and one without a proposal (gen is null) for a row that has none, hash partitioned by row.

    Columns: row, doc_id, gen, start, stop, match, before, after.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), text.alias("text"))
    found = []
    for k, g in enumerate(GENERATORS):
        hint = F.contains("text", F.lit(g.hint)) if len(g.hint) == 1 else F.col("text").rlike(g.hint)
        matches = F.when(hint, F.regexp_extract_all("text", F.lit(g.pattern), F.lit(0)))
        found.append(F.struct(F.lit(k).alias("gen"), matches.alias("matches")))
    some = rows.withColumn("found", F.array(*found)).withColumn("found", F.filter("found", lambda x: F.size(x["matches"]) > 0))
    each = some.select("row", "doc_id", "text", F.explode_outer("found").alias("f")).select("row", "doc_id", "text", "f.gen", "f.matches")
    pattern = F.element_at(F.array(*[F.lit(g.pattern) for g in GENERATORS]), F.col("gen") + 1)
    gaps = F.when(F.col("gen").isNotNull(), F.split("text", pattern, -1))
    each = each.select("row", "doc_id", "gen", "matches", gaps.alias("gaps"))
    zipped = F.arrays_zip("matches", F.col("gaps"), F.slice("gaps", 2, F.greatest(F.size("matches"), F.lit(1))).alias("next"))
    each = each.select("row", "doc_id", "gen", F.posexplode_outer(F.when(F.col("gen").isNotNull(), zipped)).alias("at", "z"))
    each = each.where(F.col("gen").isNull() | F.col("z.matches").isNotNull()).select(
        "row", "doc_id", "gen", "at", F.col("z.matches").alias("match"), F.length("z.gaps").alias("gap"),
        F.expr(f"right(z.gaps, {CONTEXT})").alias("before"), F.expr(f"left(z.next, {CONTEXT})").alias("after"),
    )
    so_far = Window.partitionBy("row", "gen").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.length("match")).over(so_far).cast("long")
    return each.repartition("row").withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("match")).drop("at", "gap")


def _side(character: Column) -> Column:
    return F.when(character.rlike("[0-9]"), 3).when(character.rlike("[A-Za-z_]"), 2).when(character.rlike(r"[+@/\-=#]"), 1).otherwise(0)


def described(found: DataFrame) -> DataFrame:
    """Proposals with their features, and whether they are base spans."""
    digits = _digits(F.col("match"))
    kind = F.element_at(F.array(*[F.lit(KINDS.index(g.kind)) for g in GENERATORS]), F.col("gen") + 1)
    fixed = F.element_at(F.array(*[F.lit(g.base) for g in GENERATORS]), F.col("gen") + 1)
    df = found.withColumn("kind", kind).withColumn("_d", digits).withColumn("fixed", fixed)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    df = df.select(
        "*", F.length("_d").alias("digits"), F.length("match").alias("chars"),
        F.length(F.regexp_replace("match", r"[A-Za-z0-9]", "")).alias("breaks"),
        flag(_luhn(F.col("_d"))).alias("luhn"),
        F.coalesce(F.expr("try_cast(left(_d, 1) AS int)"), F.lit(-1)).alias("lead"),
        flag(F.contains("match", F.lit("+"))).alias("plus"), flag(F.contains("match", F.lit("("))).alias("bracket"),
        _side(F.coalesce(F.expr("right(`before`, 1)"), F.lit(""))).alias("_b"), _side(F.coalesce(F.expr("left(`after`, 1)"), F.lit(""))).alias("_a"),
        flag(F.col("before").rlike(_WANTED)).alias("wanted"), flag(F.col("before").rlike(_OTHER)).alias("other"),
        F.size(F.array_distinct(F.split(F.left(F.col("_d"), F.lit(40)), ""))).alias("variety"),
    )
    parts = F.split("match", r"\.")
    small = F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3)
    value = F.forall(parts, lambda p: F.coalesce(F.expr("int(1)") * F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255)
    passes = (
        F.when(F.col("kind") == 0, True)
        .when(F.col("kind") == 1, small & value)
        .when(F.col("kind") == 2, F.col("digits").between(16, 19) & (F.col("luhn") == 1))
        .otherwise(F.col("digits").between(8, 15))
    )
    return df.withColumn("base", F.coalesce(F.col("fixed") & passes, F.lit(False))).drop("before", "after", "_d").withColumnsRenamed({"_b": "before", "_a": "after"})


def _examples(n: int, seed: int = 8) -> list[tuple[str, int, int, str]]:
    """Labelled sentences: text, and the span of the number or address in it, with its kind or an empty string."""
    rng = random.Random(seed)
    figures = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    words = lambda: " ".join("".join(rng.choice(("an", "ti", "er", "on", "le", "sch", "ción", "eau", "the", "in")) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 6)))

    def luhn(k: int, valid: bool, lead: str) -> str:
        body = lead + figures(k - 2)
        total = sum(int(d) if j % 2 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for j, d in enumerate(reversed(body)))
        last = -total % 10
        return body + str(last if valid else (last + rng.randint(1, 9)) % 10)

    def grouped(x: str) -> str:
        return rng.choice((" ", "-")).join(x[k : k + 4] for k in range(0, 16, 4)) if len(x) == 16 and rng.random() < 0.4 else x

    out = []
    for _ in range(n):
        way = rng.randrange(9)
        if way < 2:
            item, kind = grouped(luhn(rng.choice((13, 15, 16, 16, 16, 16, 19)), True, rng.choice("3444555566"))), "card"
        elif way < 4:
            item, kind = grouped(luhn(rng.choice((13, 14, 15, 16, 16, 17, 18, 19)), rng.random() < 0.05, rng.choice("0123456789"))), ""
            kind = ""
        elif way < 6:
            form = rng.choice(("({}) {}-{}", "+1 ({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "1-{}-{}-{}", "+44 {} {} {}"))
            item, kind = form.format(str(rng.randint(200, 999)), figures(3), figures(4)), "phone"
        elif way < 7:
            item, kind = rng.choice(("{}-{}-{}", "{} {} {}", "{}.{}.{}")).format(figures(3), figures(3), figures(4)), ""
        else:
            name, host = rng.choice(("jo.li", "anna7", "k_m", "ops")), rng.choice(("mail", "post2", "x-net"))
            item, kind = f"{name}{rng.choice((' [at] ', ' (at) ', '(at)', '[at]'))}{host}{rng.choice(('.', ' [dot] ', '(dot)'))}{rng.choice(('com', 'org', 'example'))}", "email"
        if kind:
            lead = rng.choice(("", "", "", "call ", "tel: ", "card ", "paid by card: ", "contact ", "mail ", "+1 (578) 555-6437 ", "4918187128635271 "))
            tail = rng.choice((" ", ". ", ", ", " ", " 4918187128635271 ", " 10.1.2.3 "))
        else:
            lead = rng.choice(("order ", "ISBN ", "ref. ", "invoice no. ", "serial: ", "part ", "x=", "#", "build ", "batch-", "/", "time stamp ", "id: "))
            tail = rng.choice((" ", ". ", "-", "/", "a", ", "))
        before = f"{words()} {lead}"
        out.append((f"{before}{item}{tail}{words()}", len(before), len(before) + len(item), kind))
    # Prices and places written like a masked address.
    for _ in range(n // 10):
        item = f"{rng.choice(('', 'x', 'qty'))}{figures(rng.randint(1, 4))}{rng.choice((' [at] ', ' (at) ', '(at)', '[at]'))}{figures(rng.randint(1, 3))}{rng.choice(('.', ' . ', '(dot)'))}{figures(rng.randint(1, 3))}"
        before = f"{words()} {rng.choice(('order ', 'ref. ', 'invoice no. ', 'part ', 'build ', 'time stamp ', '', 'id: '))}"
        out.append((f"{before}{item}{rng.choice((' ', '. ', ', '))}{words()}", len(before), len(before) + len(item), ""))
    return out


@dataclass(frozen=True)
class Model:
    start: float
    trees: tuple
    scale: float
    shift: float
    thresholds: tuple[float, ...]

    def probability(self) -> Column:
        score = boosting.expression(self.start, list(self.trees), [F.col(f).cast("double") for f in FEATURES])
        return 1 / (1 + F.exp(-(score * self.scale + self.shift)))


@lru_cache(maxsize=4)
def _fit(spark, labelled: int, precision: float) -> Model:
    made = _examples(labelled)
    values = ", ".join("({}L, '{}', {}, {}, '{}')".format(k, t.replace("\\", "\\\\").replace("'", "\\'"), a, b, kind) for k, (t, a, b, kind) in enumerate(made))
    rows = spark.sql(f"SELECT * FROM VALUES {values} AS t(doc_id, text, a, b, truth)")
    found = described(candidates(rows)).where("gen IS NOT NULL AND NOT fixed")
    got = found.join(rows.drop("text"), "doc_id").orderBy("doc_id", "gen", "start").collect()
    x = np.asarray([[r[f] for f in FEATURES] for r in got], dtype=float)
    # A proposal is right when it covers the item, give or take a country code or a blank at either end.
    y = np.asarray([float(r.truth == KINDS[r.kind] and abs(r.start - r.a) <= 3 and abs(r.stop - r.b) <= 1) for r in got])
    # The numbers set around the examples are personal data too, but not theirs: they say nothing.
    clear = np.asarray([r.start < r.b and r.a < r.stop for r in got], dtype=bool)
    group = np.asarray([r.doc_id % 3 for r in got])
    start, trees = boosting.fit(x[clear & (group != 0)], y[clear & (group != 0)])
    aside = clear & (group == 0)
    score = boosting.scores(start, trees, x[aside])
    scale, shift = boosting.platt(score, y[aside])
    p = 1 / (1 + np.exp(-(score * scale + shift)))
    limit = []
    for k in range(len(KINDS)):
        here, best = x[aside][:, 0] == k, 1.1
        for t in sorted(set(p[here & (y[aside] == 1)]), reverse=True):
            if y[aside][here & (p >= t)].mean() < precision:
                break
            best = t
        limit.append(float(max(0.5, best)))
    return Model(start, tuple(trees), scale, shift, tuple(limit))


def train(spark, labelled: int = LABELLED, precision: float = PRECISION) -> Model:
    """Fit trees, calibration and thresholds; kept for the session."""
    return _fit(spark, labelled, precision)


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and spans of every row: an array of (kind, start, stop, base, p) by kind as listed, then start."""
    model = model or train(docs.sparkSession)
    df = described(candidates(docs)).withColumn("p", F.when(~F.col("base"), model.probability()))
    limit = F.element_at(F.array(*[F.lit(t) for t in model.thresholds]), F.col("kind") + 1)
    df = df.withColumn("added", ~F.col("base") & ~F.col("fixed") & (F.col("p") >= limit))
    # By start: base spans that begin earlier and end later than a proposal's start, or begin before its end, overlap it.
    order = Window.partitionBy("row").orderBy("start", F.desc("stop"), "gen")
    past, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumns({
        "_past": F.max(F.when(F.col("base"), F.col("stop"))).over(past),
        "_next": F.min(F.when(F.col("base"), F.col("start"))).over(ahead),
    })
    free = (F.coalesce("_past", F.lit(-1)) <= F.col("start")) & (F.coalesce("_next", F.col("stop")) >= F.col("stop"))
    span = F.struct("kind", "start", "stop", "base", "p")
    more = F.when(F.col("added") & free, F.struct("start", (-F.col("stop")).alias("length"), "gen", span.alias("span")))
    rows = df.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.collect_list(F.when(F.col("base"), span)).alias("base"), F.array_sort(F.collect_list(more)).alias("more")
    )
    none = F.struct(F.lit(-1).cast("long").alias("stop"), F.slice("base", 1, 0).alias("kept"))
    taken = F.aggregate(
        "more", none, lambda a, x: F.when(x["start"] >= a["stop"], F.struct(x["span"]["stop"].alias("stop"), F.array_append(a["kept"], x["span"]).alias("kept"))).otherwise(a)
    )
    return rows.select("doc_id", F.array_sort(F.concat("base", taken["kept"])).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from find()."""
    named = F.array(*[F.lit(k) for k in KINDS])

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(named, s["kind"] + 1), s["start"], s["stop"])), ",")

    base = F.filter("spans", lambda s: s["base"])
    n = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[n(k) for k in range(len(KINDS))], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    return digest(find(spark.read.parquet(f"{sf_dir}/documents.parquet")))
