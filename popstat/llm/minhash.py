"""One-permutation MinHash fingerprints of run logs and haplotypes, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popstat.operators.groups import By, dense_range
from popstat.operators.ordered import previous_value

#: Bins of a fingerprint and bits kept of each bin's smallest hash; 16 bins of 4 bits are one number of it.
BINS, BITS = 256, 4
#: Bins that an empty bin tries before it ranks all filled ones.
TRIES = 12
_TOP = 56  # a hash's first byte is its bin
_REST = (1 << _TOP) - 1
_PRIME = (1 << 31) - 1
_WHITE = " \t\n\x0b\x0c\r"


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _shingle_hashes(words: str, width: int) -> Column:
    """Hashes of the word windows of an array column; fewer words are one window, none give none."""
    w, n = F.col(words), F.size(words)
    window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])
    short = F.when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<long>"))
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), window)).otherwise(short)


def _bin_minima(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """The smallest hash of every bin, in the order of bins; the largest possible one stands for an empty bin."""
    empty = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda b: F.shiftleft(b.cast("long"), _TOP).bitwiseOR(F.lit(_REST)))
    ordered = df.withColumn("_sorted", F.sort_array(F.concat(F.col(hashes), empty)))
    s = F.col("_sorted")
    first = lambda x, i: (i == 0) | (F.shiftright(x, _TOP) != F.shiftright(F.get(s, i - 1), _TOP))
    return ordered.withColumn(name, F.filter(s, first)).drop("_sorted")


def _packed(df: DataFrame, minima: str, name: str) -> DataFrame:
    """Low-order bits of every bin packed into numbers, empty bins filled first.

    An empty bin takes the value of a filled one: the first of a row of bins that hashes
    of its number for each attempt give, then the filled bin that
    ranks first by a hash of both. The row of bins does not depend on the set, so equal sets
    fill alike and each filled bin is equally likely. A lent value is hashed with the bin's
    number, so that unlike values agree by chance in each bin anew.
    """
    m = F.col(minima)
    held = lambda j: F.when(F.get(m, j).bitwiseAND(F.lit(_REST)) != _REST, F.get(m, j))
    filled = df.withColumn("_full", F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(m, j).bitwiseAND(F.lit(_REST)) != _REST))

    def value(i: Column) -> Column:
        tried = [held(i)]
        for a in range(1, TRIES + 1):
            factor, offset = (c * (2 * a + 1) % _PRIME for c in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
            tried.append(held(((i * F.lit(factor).cast("long") + F.lit(offset)) % _PRIME % BINS).cast("int")))
        ranked = F.array_min(F.transform(F.col("_full"), lambda j: F.struct(F.xxhash64(i, j).alias("r"), F.get(m, j).alias("v"))))["v"]
        lent = F.xxhash64(i, F.coalesce(*tried[1:], ranked))
        return F.when(F.size("_full") == 0, F.lit(0).cast("long")).otherwise(F.coalesce(tried[0], lent))

    low = (1 << BITS) - 1
    each = 64 // BITS
    word = lambda w: F.aggregate(
        F.sequence(F.lit(0), F.lit(each - 1)), F.lit(0).cast("long"),
        lambda packed, j: F.shiftleft(packed, BITS).bitwiseOR(value(w * each + j).bitwiseAND(F.lit(low).cast("long"))),
    )
    return filled.withColumn(name, F.transform(F.sequence(F.lit(0), F.lit(BINS // each - 1)), word)).drop("_full")


def with_fingerprint(df: DataFrame, text: str, name: str, words: int = 5) -> DataFrame:
    """``df`` with the packed fingerprint of a text column, an array of 64-bit numbers."""
    trimmed = df.withColumn("_trimmed", F.btrim(F.coalesce(text, F.lit("")), F.lit(_WHITE)))
    split = F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", r"[\x20\x09-\x0D]+"))
    hashed = trimmed.withColumn("_words", split).drop("_trimmed").withColumn("_hashes", _shingle_hashes("_words", words)).drop("_words")
    return _packed(_bin_minima(hashed, "_hashes", "_minima").drop("_hashes"), "_minima", name).drop("_minima")


def shown(packed: Column) -> Column:
    """A packed fingerprint in hexadecimal digits."""
    return F.lower(F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common members of two sets, 0 to 1, from their packed fingerprints.

    Bins of unlike sets agree by chance in one of 2**BITS cases, which is taken off.
    """
    ones = F.lit(_signed(0x1111111111111111))

    def differ(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        return F.bit_count(d.bitwiseOR(F.shiftright(d, 1)).bitwiseOR(F.shiftright(d, 2)).bitwiseOR(F.shiftright(d, 3)).bitwiseAND(ones))

    others = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda n, d: n + d)
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), ((BINS - others) / F.lit(float(BINS)) - chance) / (1 - chance))


def log_minhashes(logs: DataFrame, words: int = 5, run_id: str = "run_id", log: str = "log") -> DataFrame:
    """``run_id`` and ``fingerprint`` of the captured output of each run.

    The members of a log's set are its windows of ``words`` words; words stand between
    ASCII white space and keep their case. A log of fewer words is one window; one without
    words, or NULL, has an empty set, whose fingerprint is all zeros. One row per input row,
    also for repeated rows and ids and a NULL id; other columns are ignored. Nothing is
    shuffled.
    """
    texts = logs.select(F.col(run_id).alias("_run"), F.col(log).cast("string").alias("_log"))
    printed = with_fingerprint(texts, "_log", "_packed", words)
    return printed.select(F.col("_run").alias(run_id), shown(F.col("_packed")).alias("fingerprint"))


def haplotype_minhashes(
    carriers: DataFrame, haplotypes: DataFrame, by: By = (), haplotype_id: str = "haplotype_id", mutation_id: str = "mutation_id"
) -> DataFrame:
    """``by``, ``haplotype_id``, ``fingerprint`` and ``packed`` of the mutations that each haplotype carries.

    ``likeness`` of two packed fingerprints estimates the Jaccard similarity that the exact
    pairwise operators give. Smallest hashes are taken per haplotype and bin before anything
    is gathered, so a haplotype brings at most BINS values, whatever it carries. Haplotypes
    without mutations are an empty set; repeated carrier rows count once; a NULL mutation is
    none; carriers of haplotypes that are not in ``haplotypes`` are ignored.
    """
    keys = [*by, haplotype_id]
    hashed = carriers.where(F.col(mutation_id).isNotNull()).select(*keys, F.xxhash64(mutation_id).alias("_h"))
    minima = hashed.groupBy(*keys, F.shiftright("_h", _TOP).alias("_bin")).agg(F.min("_h").alias("_h"))
    gathered = minima.groupBy(*keys).agg(F.collect_list("_h").alias("_hashes"))
    all_of = haplotypes.select(*keys).distinct().join(gathered, keys, "left")
    held = all_of.withColumn("_hashes", F.coalesce("_hashes", F.array().cast("array<long>")))
    packed = _packed(_bin_minima(held, "_hashes", "_minima").drop("_hashes"), "_minima", "packed").drop("_minima")
    return packed.select(*keys, shown(F.col("packed")).alias("fingerprint"), "packed")


def edited_log_likeness(logs: DataFrame, words: int = 5, run_id: str = "run_id", log: str = "log") -> DataFrame:
    """Fingerprints of run logs beside those of texts that are known to share half with them.

    The edited text of a log is the log with its last half of code points, rounded down,
    replaced by the first as many, or all, of the next log: in descending order of
    ``run_id``, NULL last, equal ids in an order given by their texts; after the last comes
    the first. The result has one row per input row: ``run_id``, ``n_chars`` (code
    points), ``edited``, ``fingerprint``, ``edited_fingerprint`` and the likeness of the
    log to its edited text, ``near_edited``, and to the next log, ``near_next``. A NULL log
    is an empty text. Rows equal in id and text follow each other. Other columns are ignored.

    Ids and lengths are ordered in slices; texts are shuffled once by a 128-bit name of
    id and text, and the half that goes to another log once more.
    """
    text = F.coalesce(F.col(log).cast("string"), F.lit(""))
    named = logs.select(F.col(run_id).alias("_run"), text.alias("_log"))
    named = named.select("*", F.xxhash64("_run", "_log").alias("_k1"), F.xxhash64(F.lit(1), "_run", "_log").alias("_k2"))
    keys = ["_k1", "_k2"]

    places = named.select("_run", *keys, F.char_length("_log").alias("_n")).groupBy(*keys).agg(F.first("_run").alias("_run"), F.first("_n").alias("_n"))
    places = places.withColumn("_key", F.struct(*keys))
    ahead = previous_value(places, "_next", "_key", ["_run", *keys])
    first = ahead.agg(F.max_by("_key", F.struct("_run", *keys)).alias("_first")).scalar()
    ahead = ahead.select("_k1", "_k2", F.coalesce("_next", first).alias("_next"), F.floor(F.col("_n") / 2).cast("int").alias("_half"))
    ahead = ahead.select(F.col("_next._k1").alias("_k1"), F.col("_next._k2").alias("_k2"), "_half", F.col("_k1").alias("_to1"), F.col("_k2").alias("_to2"))

    printed = with_fingerprint(named, "_log", "_packed", words)
    # Both sides below read the same columns, so that the planner shuffles the texts once for both
    distinct = printed.groupBy(*keys).agg(F.first(F.struct("_run", "_log", "_packed")).alias("_of"), F.count("*").alias("_copies"))
    gifts = distinct.where("_copies > 0").join(ahead, keys).select(
        F.col("_to1").alias("_k1"), F.col("_to2").alias("_k2"), "_half", F.expr("left(_of._log, _half)").alias("_start"), F.col("_of._packed").alias("_after")
    )
    distinct = distinct.select(*keys, "_of.*", "_copies")
    copies = dense_range(distinct.join(gifts, keys).withColumn("_last", F.col("_copies") - 1), "_copy", "_last")
    own = F.col("_copy") == F.col("_last")  # the other copies are followed by a copy
    edited = copies.select(
        F.col("_run").alias(run_id), F.char_length("_log").cast("long").alias("n_chars"), "_packed",
        F.expr("left(_log, char_length(_log) - _half)").alias("_kept"),
        F.when(own, F.col("_start")).otherwise(F.expr("left(_log, _half)")).alias("_new"),
        F.when(own, F.col("_after")).otherwise(F.col("_packed")).alias("_after"),
    ).withColumn("edited", F.concat("_kept", "_new"))
    done = with_fingerprint(edited, "edited", "_edited", words)
    return done.select(
        run_id, "n_chars", "edited", shown(F.col("_packed")).alias("fingerprint"), shown(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_packed"), F.col("_edited")).alias("near_edited"), likeness(F.col("_packed"), F.col("_after")).alias("near_next"),
    )
