"""Expected tests against actual test results.

``match_expected`` looks an expected name up in four tiers: the same name, the same normalised
name, a name that contains it or is contained in it, and more than half of the words shared.

Runs of at most ``SMALL`` expected and actual names, which are counted first, are gathered in one row each, and every expected name of
such a row is held against every actual one there. What is larger goes by equality joins, whatever its size, with the same
results. The first two tiers join on (keys, lookup name). For containment a name
that may hold others is indexed by its windows of 1, 2, 4, ... characters; a name that may be held is looked up by the rarest of
its windows of at least half its length, and what it meets there is compared. For words only those count that both sides have; names alike in them are one, and two names that share
more than half of their words must share one of the few rarest of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patcheval import constants as C
from patcheval.functions import text as tx
from patcheval.functions.stage import staged
from patcheval.operators.named_logs import KEYS

TIERS = ("exact", "normalised", "contains", "words")
#: Names on either side up to which the names of a run are gathered in one row.
SMALL = 32


def _actual_lookup(actual: DataFrame, keys) -> DataFrame:
    """(keys, lookup, raw, normal): what a name finds as an actual name, and as the normalised form
    of an actual name (the first in list order)."""
    found = F.struct("position", "status", "name")
    return (
        actual.select(
            *keys, found.alias("found"),
            F.explode_outer(
                F.array(
                    F.struct(F.col("name").alias("lookup"), F.lit(True).alias("is_raw")),
                    F.struct(tx.normalize_test_name(F.col("name")).alias("lookup"), F.lit(False).alias("is_raw")),
                )
            ).alias("entry"),
        )
        .select(*keys, "found", "entry.*")
        .groupBy(*keys, "lookup")
        .agg(
            F.min(F.when(F.col("is_raw"), F.col("found"))).alias("raw"),
            F.min(F.when(~F.col("is_raw"), F.col("found"))).alias("normal"),
        )
    )


def _named_hits(expected: DataFrame, actual: DataFrame, keys, item) -> DataFrame:
    """Expected rows with ``hit`` (tier 1 or 2, else null) and ``detail`` (exact or first normalised)."""
    probes = expected.withColumn(
        "probe",
        F.explode_outer(
            F.array(
                F.struct(F.col("name").alias("lookup"), F.lit(0).alias("step")),
                F.struct(tx.normalize_test_name(F.col("name")).alias("lookup"), F.lit(1).alias("step")),
            )
        ),
    ).select(*keys, *item, "probe.*")
    by_name, by_norm = F.col("step") == 0, F.col("step") == 1
    raw, normal = F.col("raw"), F.col("normal")

    def ranked(rank, tier, found):
        return F.when(
            found.isNotNull(),
            F.struct(F.lit(rank).alias("rank"), F.lit(tier).alias("tier"), found.alias("found")),
        )

    looked_up = probes.join(_actual_lookup(actual, keys), [*keys, "lookup"], "left")
    best = F.coalesce(
        F.when(by_name, F.coalesce(ranked(0, "exact", raw), ranked(1, "normalised", normal))),
        F.when(by_norm, F.coalesce(ranked(2, "normalised", raw), ranked(3, "normalised", normal))),
    )
    detail = F.coalesce(
        F.when(by_name, ranked(0, "exact", raw)), F.when(by_norm, ranked(3, "normalised", normal))
    )
    return (
        looked_up.withColumn("best", best)
        .withColumn("detail", detail)
        .groupBy(*keys, *item)
        .agg(F.min("best").alias("hit"), F.min("detail").alias("detail"))
    )


def _window_size(text: Column) -> Column:
    """The largest power of two that is no more than the text's length; 0 for an empty text."""
    n = F.length(text)
    return F.when(n == 0, 0).otherwise(F.call_function("shiftleft", F.lit(1), F.length(F.bin(n)) - 1)).cast("int")


def _windows(text: Column, sizes: Column) -> Column:
    """Hashes of the different windows of ``sizes`` characters of a text of a run. What they bring together is compared."""

    def of_size(n):
        last = F.length(text) - n + 1
        starts = F.when(n == 0, F.array(F.lit(1))).when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1))))
        return F.coalesce(F.transform(starts, lambda i: F.xxhash64(n, "run", F.substr(text, i, n))), F.array().cast("array<bigint>"))

    return F.array_distinct(F.flatten(F.transform(sizes, of_size)))


def _rarest_windows(needles: DataFrame, stacks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, g, n, first): of each needle's windows of at least half its length the one that the fewest stacks hold, how many
    these are, and the first of them (position, id); needles with a window that none holds are left out. (g, id): stacks by windows.

    Both sides have (id, run, position, norm). A stack has windows of a few sizes only, at most one for each doubling up to its
    length: L log L rows, not one for each of its substrings.
    """
    sized = needles.withColumn("w", _window_size(F.col("norm"))).withColumn("gs", _windows(F.col("norm"), F.array("w")))
    mine = staged(sized.select("id", F.size("gs").alias("all"), F.explode("gs").alias("g")), "match-windows")
    # sizes of one run: at most as many as a length has bits
    sizes = sized.groupBy("run").agg(F.collect_set("w").alias("sizes"))
    theirs = stacks.join(sizes, "run").select("id", "position", F.explode(_windows(F.col("norm"), F.col("sizes"))).alias("g"))
    held = staged(theirs.join(mine.select("g").distinct(), "g", "left_semi"), "match-held")
    counts = held.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("position", "id")).alias("first"))
    best = mine.join(counts, "g").groupBy("id").agg(
        F.count(F.lit(1)).alias("seen"), F.first("all").alias("all"), F.min(F.struct("n", "g", "first")).alias("best")
    )
    return best.where(F.col("seen") == F.col("all")).select("id", "best.g", "best.n", "best.first"), held.select("g", "id")


def _contain(pairs: DataFrame, needles: DataFrame, stacks: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (id of a needle, stack) in which the stack, of the same run, contains the needle."""
    inner = needles.select("id", "run", F.col("norm").alias("_needle"))
    outer = stacks.select(F.col("id").alias("stack"), F.col("run").alias("_run"), F.col("norm").alias("_stack"))
    both = pairs.join(inner, "id").join(outer, "stack")
    return both.where((F.col("run") == F.col("_run")) & F.contains("_stack", "_needle")).drop("run", "_run", "_needle", "_stack")


def _containment(wanted: DataFrame, firsts: DataFrame) -> DataFrame:
    """(id, position): the first actual name that contains, or is contained in, each wanted one."""
    # which actual names contain a wanted one: the first with its rarest window mostly does, else all that have it are tried
    best, held = _rarest_windows(wanted, firsts)
    best = staged(best, "match-rarest")
    first = _contain(best.select("id", F.col("first.id").alias("stack"), F.col("first.position").alias("position")), wanted, firsts).drop("stack")
    first = staged(first, "match-first")
    left = best.where("n > 1").join(first, "id", "left_anti").join(held.withColumnRenamed("id", "stack"), "g").where(F.col("stack") != F.col("first.id"))
    later = _contain(left.select("id", "stack"), wanted, firsts).join(firsts.select(F.col("id").alias("stack"), "position"), "stack")
    outer = first.unionByName(later.select("id", "position"))
    # which actual names a wanted one contains
    best, held = _rarest_windows(firsts, wanted)
    pairs = best.select("id", "g").join(held.withColumnRenamed("id", "stack"), "g").select("id", "stack")
    inner = _contain(pairs, firsts, wanted).join(firsts.select("id", "position"), "id").select(F.col("stack").alias("id"), "position")
    return outer.unionByName(inner).groupBy("id").agg(F.min("position").alias("position"))


def _word_overlap(wanted: DataFrame, firsts: DataFrame) -> DataFrame:
    """(id, score, position): the best actual name by shared words over all words, above one half, the earliest of equals."""
    def worded(df, *more):
        return df.withColumn("w", tx.words_of(F.col("norm"))).select("id", "run", *more, F.size("w").alias("n"), F.explode("w").alias("word"))

    mine, theirs = worded(wanted), worded(firsts, "position")
    uses = lambda df: df.groupBy("run", "word").agg(F.count(F.lit(1)).alias("uses"))
    # a word of one side only is shared with nobody; the others are numbered
    common = staged(
        uses(mine).join(uses(theirs).withColumnRenamed("uses", "others"), ["run", "word"]).select(
            "run", "word", (F.col("uses") + F.col("others")).alias("uses"), F.monotonically_increasing_id().alias("no")
        ),
        "match-words",
    )

    def signatures(df, *more):
        # the words of one name, rarest first
        return df.join(common, ["run", "word"]).groupBy("id", *more, "n").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("uses", "no"))), lambda x: x["no"]).alias("words")
        )

    def rare(df, **names):
        # of n words over n / 2 must be shared: one of those left when all but one of so many are taken away
        count = F.greatest(F.size("words") - F.floor(F.col("n") / 2), F.lit(0)).cast("int")
        return df.withColumn("word", F.explode(F.slice("words", F.lit(1), count))).withColumnsRenamed(names)

    own = staged(signatures(mine), "match-signatures")
    left = rare(own.select("n", "words").distinct())
    right = rare(signatures(theirs, "position").groupBy("n", "words").agg(F.min("position").alias("position")), n="m", words="other")
    shared = F.size(F.array_intersect("words", "other"))
    best = (
        left.join(right, "word")
        # sharing more than half is impossible when one has twice the words of the other
        .where((F.col("m") < 2 * F.col("n")) & (F.col("n") < 2 * F.col("m")))
        .withColumn("score", shared / (F.col("n") + F.col("m") - shared)).where("score > 0.5")
        .groupBy("n", "words").agg(F.min(F.struct((-F.col("score")).alias("minus"), "position")).alias("best"))
    )
    return own.join(best, ["n", "words"]).select("id", (-F.col("best.minus")).alias("score"), F.col("best.position").alias("position"))


def _partial_hits(leftover: DataFrame, actual: DataFrame, keys, tiers) -> DataFrame:
    """(keys, norm, tier, found) for the leftover expected names that have a partial match."""
    names = staged(leftover.select(*keys, "norm").distinct(), "match-names")
    # only runs that still have something to find; from here on a run is a number, and so is a name
    runs = staged(names.select(*keys).distinct().withColumn("run", F.monotonically_increasing_id()), "match-runs")
    number = F.monotonically_increasing_id().alias("id")
    wanted = staged(names.join(runs, list(keys)).select(*keys, "run", "norm", F.lit(0).cast("bigint").alias("position"), number), "match-wanted")
    firsts = staged(
        actual.join(runs, list(keys)).groupBy("run", tx.normalize_test_name(F.col("name")).alias("norm"))
        .agg(F.min("position").alias("position")).select("*", number),
        "match-firsts",
    )
    contained = staged(_containment(wanted, firsts), "match-contained")
    overlapping = _word_overlap(wanted.join(contained, "id", "left_anti"), firsts)
    best = contained.select("id", F.lit("contains").alias("tier"), "position").unionByName(
        overlapping.select("id", F.lit("words").alias("tier"), "position")
    )
    named = best.where(F.col("tier").isin(*tiers)).join(wanted.drop("position"), "id").select(*keys, "norm", "tier", "position")
    return named.join(actual.select(*keys, "position", "status", "name"), [*keys, "position"]).select(
        *keys, "norm", "tier", F.struct("position", "status", "name").alias("found")
    )


def _large_runs(expected: DataFrame, actual: DataFrame, keys) -> DataFrame:
    """(_run): hashes of the keys that have more than ``SMALL`` rows on a side. Runs that share a hash are counted together."""
    side = lambda df, e: df.select(F.xxhash64(*keys).alias("_run"), F.lit(e).alias("e"))
    counts = side(expected, 1).unionByName(side(actual, 0)).groupBy("_run").agg(F.sum("e").alias("e"), F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("e") > SMALL) | (F.col("n") - F.col("e") > SMALL)).select("_run")


def _within_runs(expected: DataFrame, actual: DataFrame, keys, item, tiers) -> DataFrame:
    """(keys, item, detail, tier, found) of expected rows of small runs, each compared with all actual names of its run."""
    side = lambda df, name, *cols: df.select(*keys, F.struct(*cols).alias(name))
    both = side(expected, "e", *item).unionByName(side(actual, "a", "position", "status", "name"), allowMissingColumns=True)
    runs = both.groupBy(*keys).agg(F.array_distinct(F.collect_list("e")).alias("es"), F.collect_list("a").alias("as"))
    # a null key equals no other
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    normed = F.transform("as", lambda a: F.struct(a.alias("found"), tx.normalize_test_name(a["name"]).alias("norm")))
    # expected names are normalised before they are rows, else Spark may move that into the comparison with each actual one
    wanted = F.transform("es", lambda e: F.struct(*[e[c].alias(c) for c in item], tx.normalize_test_name(e["name"]).alias("norm")))
    rows = (
        runs.where(F.size("es") > 0)
        .select(*keys, wanted.alias("es"), F.when(known, normed).otherwise(F.array().cast(f"array<struct<found:{_type(both, 'a')},norm:string>>")).alias("as"))
        .select(*keys, "as", F.explode_outer("es").alias("e"))
        .select(*keys, "as", *[F.col("e")[c].alias(c) for c in (*item, "norm")])
    )
    name, norm = F.col("name"), F.col("norm")

    def ranked(*steps):
        def of(a):
            when = F
            for rank, (tier, same) in steps:
                when = when.when(same(a), F.struct(F.lit(rank).alias("rank"), F.lit(tier).alias("tier"), a["found"].alias("found")))
            return when

        return F.array_min(F.transform("as", of))

    exact, last = ("exact", lambda a: a["found"]["name"] == name), ("normalised", lambda a: a["norm"] == norm)
    middle = [("normalised", lambda a: a["norm"] == name), ("normalised", lambda a: a["found"]["name"] == norm)]
    rows = rows.withColumn("hit", ranked(*enumerate([exact, *middle, last]))).withColumn("detail", ranked((0, exact), (3, last)))
    tier, found = F.col("hit.tier"), F.col("hit.found")
    if set(tiers) & {"contains", "words"}:
        # a name that no position leads to is met, and then nothing is found
        at = lambda a: a["found"]["position"].isNotNull()
        lost = lambda a: ~at(a) & ~F.exists("as", lambda b: at(b) & (b["norm"] == a["norm"]))
        held = F.filter("as", lambda a: F.contains(a["norm"], norm) | F.contains(norm, a["norm"]))
        rows = rows.withColumn("held", F.when(F.col("hit").isNull(), held)).withColumn("words", F.when(F.size("held") == 0, tx.words_of(norm)))
        rows = rows.withColumn("hidden", F.exists("held", lambda a: F.contains(a["norm"], norm) & lost(a)))

        def scored(a):
            theirs = tx.words_of(a["norm"])
            shared = F.size(F.array_intersect("words", theirs))
            score = F.coalesce(F.try_divide(shared, F.size(F.array_union("words", theirs))), F.lit(0.0))

            # names alike in the words they share with this one are one, at the first position of any
            def alike(b):
                words = tx.words_of(b["norm"])
                return at(b) & (F.size(words) == F.size(theirs)) & (F.size(F.array_except(F.array_intersect("words", theirs), words)) == 0)

            return F.when(at(a) | ~F.exists("as", alike), F.struct((-score).alias("minus"), a["found"].alias("found")))

        first = F.array_min(F.transform("held", lambda a: F.when(at(a) & (~F.col("hidden") | F.contains(norm, a["norm"])), a["found"])))
        rows = rows.withColumn("first", first).withColumn("best", F.when(F.col("words").isNotNull(), F.array_min(F.transform("as", scored))))
        chosen = [("contains", F.col("first").isNotNull(), F.col("first")), ("words", (F.col("best.minus") < -0.5) & F.col("best.found.position").isNotNull(), F.col("best.found"))]
        for label, there, value in chosen:
            if label in tiers:
                there = F.col("hit").isNull() & there
                tier, found = F.when(there, F.lit(label)).otherwise(tier), F.when(there, value).otherwise(found)
    return rows.select(*keys, *item, "detail", tier.alias("tier"), found.alias("found"))


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _across_runs(expected: DataFrame, actual: DataFrame, keys, item, tiers) -> DataFrame:
    """(keys, item, detail, tier, found) of expected rows of runs of any size, by joins."""
    named = _named_hits(expected, actual, keys, item)
    hit = F.col("hit")
    if not set(tiers) & {"contains", "words"}:
        return named.select(*keys, *item, "detail", hit["tier"].alias("tier"), hit["found"].alias("found"))
    norm = F.when(hit.isNull(), tx.normalize_test_name(F.col("name")))
    # read once below and many times in the partial tiers
    tagged = staged(named.withColumn("norm", norm), "match-named")
    partial = _partial_hits(tagged.where("hit is null"), actual, keys, tiers)
    partial = partial.select(*keys, "norm", F.col("tier").alias("p_tier"), F.col("found").alias("p_found"))
    return tagged.join(partial, [*keys, "norm"], "left").select(
        *keys, *item, "detail",
        F.coalesce(hit["tier"], "p_tier").alias("tier"),
        F.coalesce(hit["found"], "p_found").alias("found"),
    )


def match_expected(
    expected: DataFrame,
    test_results: DataFrame,
    keys=KEYS,
    require_pass: bool = True,
    tiers=TIERS,
) -> DataFrame:
    """One row per expected test: (keys, category, ord, name, tier, actual_name, actual_status,
    outcome, detail_status, detail_name).

    ``expected`` has (keys, category, ord, name), where ``ord`` tells repeated names apart;
    ``test_results`` has (keys, position, name, status) with names unique per run and instance.
    ``outcome`` is passed, failed or missing; with ``require_pass=False`` existing is enough.
    ``detail_*`` is what a detail listing shows, which never uses partial matches.
    """
    keys = list(keys)
    item = ["category", "ord", "name"]
    # each is read for the sizes of the runs and for the names
    expected = staged(expected.select(*keys, *item), "match-expected")
    actual = staged(test_results.select(*keys, "position", "name", "status"), "match-actual")
    large = staged(_large_runs(expected, actual, keys), "match-large")
    if large.isEmpty():
        matched = _within_runs(expected, actual, keys, item, tiers)
    else:
        run = F.xxhash64(*keys)

        def part(df, how):
            return df.withColumn("_run", run).join(large, "_run", how).drop("_run")

        matched = _within_runs(part(expected, "left_anti"), part(actual, "left_anti"), keys, item, tiers)
        across = _across_runs(part(expected, "left_semi"), staged(part(actual, "left_semi"), "match-actual-large"), keys, item, tiers)
        matched = matched.unionByName(across)
    found = F.col("found")
    passed = (found["status"] == C.PASSED) if require_pass else F.lit(True)
    return matched.select(
        *keys, *item, "tier",
        found["name"].alias("actual_name"),
        found["status"].alias("actual_status"),
        F.when(found.isNull(), "missing").when(passed, C.PASSED).otherwise(C.FAILED).alias("outcome"),
        F.coalesce(F.col("detail")["found"]["status"], F.lit(C.ERROR)).alias("detail_status"),
        F.coalesce(F.col("detail")["found"]["name"], F.col("name")).alias("detail_name"),
        F.col("detail")["found"]["position"].alias("detail_position"),
    )


def detail_results(matches: DataFrame, test_results: DataFrame, keys=KEYS) -> DataFrame:
    """Detail rows of a grade: the matched test with its duration and error text, or an error row."""
    keys = list(keys)
    extra = test_results.select(
        *keys, F.col("position").alias("detail_position"), "duration_ms", "error_message", "stack_trace"
    )
    missing = F.col("detail_position").isNull()
    return matches.join(extra, [*keys, "detail_position"], "left").select(
        *keys, "category", "ord", F.col("name").alias("expected_name"),
        F.col("detail_name").alias("name"), F.col("detail_status").alias("status"), "duration_ms",
        F.when(missing, F.lit(C.TEST_NOT_FOUND)).otherwise(F.col("error_message")).alias("error_message"),
        "stack_trace",
    )
