"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss.

Base spans (leftmost, not overlapping within a kind): e-mail and IP addresses, card numbers that pass
Luhn, phone numbers with a leading +. Their strings are the seeds.

Candidates are what has the form of an identifier without being a base span: runs of digits with
separators between them (`LOOSE`; and `TIGHT`, without spaces and brackets), of MIN_DIGITS digits or more and of any length,
and addresses of a laxer form (`ADDRESS`).

Every seed and candidate stands in up to four lexical patterns: the word before it, the word after it (whatever
punctuation and space is between), its own form with each digit as 9 and each run of letters as a, and, narrower
than that, a number's form with its first digit and an address's domain. Patterns and
instances (strings without their separators) are the two sides of a graph, which is scored in rounds:

* a pattern's support is the number of its different instances that are seeds or accepted, its kind that of most of these
  (of equal numbers the first in the order of KINDS), its confidence the lower end of the 95 % interval (Wilson's) of their
  share. Beside words, instances that a base kind's check refutes (12 to 19 digits that fail Luhn, parts above 255) count in the share
  in full, other unknown ones as UNKNOWN of an instance each, since what a pattern is to discover doesn't speak against it. A form is
  common to many strings: there all unknown ones count in full and only seeds support, lest discoveries drift;
* a pattern of at least SUPPORT and CONFIDENCE discovers: an instance that is no seed scores the chance that one of its
  discovering patterns is right, and is accepted from CONFIDENCE on, with the kind of the surest pattern (of equal ones the
  best supported, then the first kind);
* accepted instances support patterns in the next round as seeds do, so that what was discovered induces new patterns.

Rounds end when the discovering patterns stay the same, or after ROUNDS. A candidate is added as a span if its
instance is known (a seed's or accepted) and it stands in a discovering pattern, or the instance is an address or has LONG digits
or more, so that it is known wherever it stands. Of added spans that overlap, the first and longest stays.

All of it is relational: matches become rows, positions are running sums, and the graph is grouped and joined; only
discovering patterns and known instances up to a counted bound are broadcast. Regular expressions take linear time:
runs start only where no run goes on, and repetitions are possessive.

Defined cases: a null text is empty; the method never removes or moves base spans and adds none that
overlaps one; copies of a text count once in the graph, and equal texts get equal spans; ties are broken as stated, so that
partitions don't matter; texts of any length are taken whole; columns other than doc_id and text are not
read; an empty table gives an empty result; ids may be null or repeat, each row has its own result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, finished, small

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = r"[0-9]++(?![\p{L}\p{N}_@])"
#: Forms of candidates. Digits that touch a letter are part of a word, not of a number.
CANDIDATES = {
    "loose": rf"(?<![\p{{L}}\p{{N}}_@.-])\+?\(?{_DIGITS}(?:[\x20()./-]{{1,2}}+{_DIGITS})*+",
    "tight": rf"(?<![\p{{L}}\p{{N}}_@.-])\+?{_DIGITS}(?:[./-]{_DIGITS})*+",
    "address": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
}
#: Least digits of a candidate number, and of one that is known wherever it stands (the least of a base number).
MIN_DIGITS, LONG = 4, 9
ROUNDS, CONFIDENCE, SUPPORT, UNKNOWN = 6, 0.7, 5, 0.05
#: 95 % of a normal distribution lie within so many deviations of its mean.
DEVIATIONS = 1.96
#: Most rows (counted) of discovering patterns or known instances that are broadcast; more are joined by a shuffle.
BROADCAST = 100_000

_WORD_BEFORE = r"(?<![\p{L}\p{N}])(\p{L}++)[^\p{L}\p{N}]*+\z"
_WORD_AFTER = r"\A[^\p{L}\p{N}]*+(\p{L}++)"


def _valid(order: Column, m: Column) -> Column:
    """Whether a base match of that kind stands."""
    parts = F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.lpad(F.regexp_replace(p, "^0+", ""), 3, "0") <= "255"))
    digits = F.translate(m, " -", "")
    card = F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    return F.when(order == 0, True).when(order == 1, parts).when(order == 2, card).otherwise(F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15))


def _hit(order: int):
    def hit(x: Column, after: Column) -> Column:
        return F.struct(
            F.lit(order).alias("ord"),
            F.char_length(x["gap"]).alias("gap"),
            x["m"].alias("m"),
            F.lower(F.regexp_extract(x["gap"], _WORD_BEFORE, 1)).alias("before"),
            F.lower(F.regexp_extract(F.coalesce(after, F.lit("")), _WORD_AFTER, 1)).alias("after"),
        )

    return hit


def matches(docs: DataFrame) -> DataFrame:
    """rid, doc_id and hits of each row: all matches with ord (of KINDS, then of CANDIDATES), the gap before each (since the last of its ord) and the words beside it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("rid", F.monotonically_increasing_id())
    held, number = F.col("text"), F.col("text").rlike("[0-9]")
    needs = {"email": held.contains("@"), "ip": held.rlike(r"[0-9]\.[0-9]"), "card": held.rlike(r"[0-9][ -]?[0-9]"), "phone": held.contains("+"), "loose": number, "tight": number, "address": held.contains("@") | held.rlike(r"at[)\]]")}
    forms = PATTERNS | CANDIDATES
    for k, p in forms.items():
        rows = rows.withColumn(f"gaps_{k}", F.when(needs[k], F.split("text", p, -1))).withColumn(f"found_{k}", F.when(needs[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))))
    each = []
    for i, k in enumerate(forms):
        pairs = F.zip_with(f"gaps_{k}", f"found_{k}", lambda g, m: F.struct(g.alias("gap"), m.alias("m")))

        # the last gap has no match behind it
        some = F.size(f"found_{k}") > 0
        each.append(F.when(some, F.zip_with(F.slice(pairs, F.lit(1), F.size(f"found_{k}")), F.slice(f"gaps_{k}", F.lit(2), F.size(f"found_{k}")), _hit(i))).otherwise(F.expr("cast(array() as array<struct<ord:int,gap:int,m:string,before:string,after:string>>)")))
    return rows.select("rid", "doc_id", F.concat(*each).alias("hits"))


def spans(found: DataFrame) -> DataFrame:
    """Base spans (ord 0 to 3) and the candidates clear of them (ord null): rid, start, end, ord, inst, long and the patterns each stands in."""
    hits = found.where(F.size("hits") > 0).select("rid", F.posexplode("hits").alias("pos", "x")).select("rid", "pos", "x.*")
    size = F.char_length("m")
    end = F.sum(F.col("gap") + size).over(Window.partitionBy("rid", "ord").orderBy("pos"))
    base = F.col("ord") < len(KINDS)
    digits = F.length(F.regexp_replace("m", "[^0-9]", ""))
    address = F.col("ord").isin(0, len(KINDS) + 2)
    wanted = F.when(base, _valid(F.col("ord"), F.col("m"))).otherwise(address | (digits >= MIN_DIGITS))
    rows = hits.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - size).where(wanted).withColumn("base", base)
    order = Window.partitionBy("rid").orderBy("start", F.desc("base"), F.desc("end"), "ord")
    # frames that end at a row are running values; one that begins at it would be computed anew for each row, so the order is turned round
    back = Window.partitionBy("rid").orderBy(F.desc("start"), "base", "end", F.desc("ord"))
    so_far, to_come = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (order, back))
    rows = rows.withColumn("reached", F.max(F.when(F.col("base"), F.col("end"))).over(so_far)).withColumn("next", F.min(F.when(F.col("base"), F.col("start"))).over(to_come))
    rows = rows.withColumn("twin", (F.lag("start").over(order) == F.col("start")) & (F.lag("end").over(order) == F.col("end")) & ~F.lag("base").over(order))
    clear = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end")) & ~F.coalesce("twin", F.lit(False))
    rows = rows.where(F.col("base") | clear)
    written = F.regexp_replace(F.regexp_replace(F.lower("m"), r"\x20?[(\[]at[)\]]\x20?", "@"), " ", "")
    ip = F.col("m").rlike(r"\A[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\z")
    inst = F.when(address, written).when(ip, F.col("m")).otherwise(F.regexp_replace("m", "[^0-9]", ""))
    family = F.when(address, "a").otherwise("n")
    form = F.when(address, F.regexp_replace(F.regexp_replace(F.lower("m"), "[a-z]+", "a"), "[0-9]+", "9")).otherwise(F.regexp_replace("m", "[0-9]", "9"))
    beside = [F.when(F.col(side) != "", F.concat(family, F.lit(f" {side} "), F.col(side))) for side in ("before", "after")]
    part = F.when(address, F.regexp_extract(written, "@(.*)", 1)).otherwise(F.concat(F.regexp_extract("m", r"\A([^0-9]*[0-9])", 1), F.regexp_replace(F.regexp_replace("m", r"\A[^0-9]*[0-9]", ""), "[0-9]", "9")))
    patterns = F.array_compact(F.array(*beside, F.concat(family, F.lit(" form "), form), F.concat(family, F.lit(" part "), part)))
    return rows.select("rid", "start", "end", F.when(base, F.col("ord")).alias("ord"), inst.alias("inst"), (address | ip | (digits >= LONG)).alias("long"), patterns.alias("patterns"))


def bootstrap(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of spans: the discovering patterns (pattern), and the known instances (inst, kind)."""
    refuted = F.when(F.col("inst").rlike(r"\A[0-9]{12,19}\z"), ~_valid(F.lit(2), F.col("inst"))).when(F.col("inst").rlike(r"\A[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\z"), ~_valid(F.lit(1), F.col("inst"))).otherwise(False)
    instances = durable(found.groupBy("inst").agg(F.min("ord").alias("seed")).withColumn("unsure", F.when(F.col("seed").isNull() & refuted, 1.0).otherwise(UNKNOWN)))
    edges = durable(found.select("inst", F.explode("patterns").alias("pattern")).distinct().join(instances, "inst").withColumn("word", F.col("pattern").rlike(r"\A. (before|after) ")))
    accepted, before = None, None
    for _ in range(ROUNDS):
        scored = edges.withColumn("kind", F.col("seed"))
        if accepted is not None:
            scored = edges.join(small(accepted.select("inst", F.col("kind").alias("got")), BROADCAST), "inst", "left").withColumn("kind", F.coalesce("seed", "got"))
        scored = scored.withColumn("kind", F.when(F.col("word"), F.col("kind")).otherwise(F.col("seed")))
        votes = [F.struct(F.count_if(F.col("kind") == k).alias("n"), F.lit(-k).alias("k")) for k in range(len(KINDS))]
        weight = F.sum(F.when(F.col("word") & F.col("kind").isNull(), F.col("unsure")).otherwise(1.0))
        patterns = scored.groupBy("pattern").agg(F.count("kind").alias("support"), F.round(weight, 6).alias("weight"), F.array_max(F.array(*votes)).alias("most"))
        share, spread = F.col("support") / F.col("weight"), DEVIATIONS**2 / F.col("weight")
        least = (share + spread / 2 - F.sqrt(spread * (share * (1 - share) + spread / 4))) / (1 + spread)
        patterns = patterns.withColumn("confidence", F.round(least, 9))
        good = durable(patterns.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).select("pattern", "confidence", "support", (-F.col("most.k")).alias("of")))
        miss = F.log(F.greatest(F.lit(1e-9), F.lit(1.0) - F.col("confidence")))
        surest = F.max(F.struct("confidence", "support", (-F.col("of")).alias("of")))
        new = edges.where("seed is null").join(small(good, BROADCAST), "pattern").groupBy("inst").agg(F.round(1.0 - F.exp(F.sum(miss)), 9).alias("score"), (-surest["of"]).alias("kind"))
        accepted = durable(new.where(F.col("score") >= CONFIDENCE))
        now = tuple(good.agg(F.count(F.lit(1)), F.sum(F.xxhash64("pattern", "of").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    known = instances.where("seed is not null").select("inst", F.col("seed").alias("kind")).unionByName(accepted.select("inst", "kind"))
    return good.select("pattern"), durable(known)


def span_text(listed: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(listed, lambda x: F.concat_ws(":", F.get(names, x["ord"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _personal_data(docs: DataFrame) -> DataFrame:
    found = durable(matches(docs))
    rows = durable(spans(found))
    good, known = bootstrap(rows)
    candidates = rows.where("ord is null").drop("ord").join(small(known, BROADCAST), "inst")
    discovered = candidates.where("not long").select("rid", "start", "end", "kind", F.explode("patterns").alias("pattern")).join(small(good, BROADCAST), "pattern", "left_semi")
    added = candidates.where("long").select("rid", "start", "end", "kind").unionByName(discovered.drop("pattern")).distinct()
    order = Window.partitionBy("rid").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    added = added.withColumn("reached", F.max("end").over(order)).where("coalesce(reached, 0) <= start")
    every = rows.where("ord is not null").select("rid", "start", "ord", "end", F.lit(True).alias("base")).unionByName(added.select("rid", "start", F.col("kind").alias("ord"), "end", F.lit(False).alias("base")))
    one = F.struct("start", "ord", "end")
    counts = [F.count_if(F.col("base") & (F.col("ord") == i)).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    per = every.groupBy("rid").agg(*counts, F.array_sort(F.collect_list(F.when(F.col("base"), one))).alias("own"), F.array_sort(F.collect_list(one)).alias("all"), F.count_if(~F.col("base")).alias("n_added"))
    none = F.lit("")
    return found.select("rid", "doc_id").join(per, "rid", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce(span_text(F.col("own")), none), 256).alias("base_sha256"),
        F.coalesce(span_text(F.col("all")), none).alias("spans"),
        F.coalesce("n_added", F.lit(0)).cast("bigint").alias("n_added"),
    )


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added of each row of ``docs`` (doc_id, text).

    The four counts are of base spans; spans also has what the patterns add, and n_added says how many those are.
    """
    return finished(docs.sparkSession, lambda: _personal_data(docs))
