"""Spelling variants among the words of run logs, found in a trie of letter-group counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from popstat.session import cut_lineage

#: Letters are in the group of their code point modulo GROUPS; a level of the upper trie holds STEP counts in one number.
GROUPS, STEP = 12, 4
LEVELS = GROUPS // STEP
#: Words below a node that one task searches, and searches for it that share a copy of its words.
LARGEST, SEARCHES = 4096, 1 << 16
#: Letters compared as arrays (longer words one by one), pairs verified at once, pairs compared on all levels at once.
LETTERS, PAIRS, FEW = 32, 1 << 17, 1 << 13
_BITS, MOST = 15, (1 << 14) - 1
_UNIT = 1 << _BITS * np.arange(STEP)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def log_words(logs: DataFrame, slips: int | None = None, least_letters: int = 6, least_n: int = 5, run_id: str = "run_id", log: str = "log") -> DataFrame:
    """``word`` and ``n``: the words of run logs of at least ``least_letters`` letters that occur ``least_n`` times.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. With
    ``slips``, misspellings are planted: where it divides the CRC-32 of ``run_id:word``, the
    word loses the letter at the place given by the CRC modulo its length. A NULL
    run_id reads as ''; a NULL log has no words.
    """
    runs = F.regexp_extract_all(F.col(log).cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{least_letters},}}"), F.lit(0))
    found = logs.select(F.coalesce(F.col(run_id).cast("string"), F.lit("")).alias("_run"), F.explode(runs).alias("_word"))
    found = found.select("_run", F.translate("_word", UPPER, LOWER).alias("word"))
    if slips:
        found = found.withColumn("_h", F.crc32(F.encode(F.concat("_run", F.lit(":"), "word"), "utf-8")))
        lost = "concat(substring(word, 1, int(_h % length(word))), substring(word, int(_h % length(word)) + 2))"
        found = found.withColumn("word", F.when(F.col("_h") % slips == 0, F.expr(lost)).otherwise(F.col("word")))
    counted = found.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_n)


def letter_counts(words: list[str]) -> np.ndarray:
    """How many letters of each group every word has."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    return np.bincount(owner * GROUPS + letters % GROUPS, minlength=len(words) * GROUPS).reshape(-1, GROUPS)


def _with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = letter_counts(batch.column("word").to_pylist()).reshape(-1, LEVELS, STEP)
        # Adding one to a count adds its unit. Counts beyond MOST are taken for it: words that are near stay within the budget
        packed = (np.minimum(counts, MOST) * _UNIT).sum(axis=2)
        levels = [pa.array(np.ascontiguousarray(packed[:, k])) for k in range(LEVELS)]
        yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), *levels], names=["word", "n", *_LEVEL])


_LEVEL = [f"v{k}" for k in range(LEVELS)]


def _changes() -> Column:
    """All changes of one level's counts within a surplus and a deficit of one: what is added, and what of both is used."""
    unit = _UNIT.tolist()
    rows = [(0, 0, 0)] + [(u, 1, 0) for u in unit] + [(-u, 0, 1) for u in unit] + [(u - v, 1, 1) for u in unit for v in unit if u != v]
    structs = [F.struct(F.lit(a).cast("long").alias("add"), F.lit(s).alias("surplus"), F.lit(d).alias("deficit")) for a, s, d in rows]
    return F.array(*structs)


def _root_key(depth: int, names: list[str]) -> list[Column]:
    """A node's own columns: its depth and its counts, 0 below it."""
    return [F.lit(depth).alias("depth"), *[(F.col(names[k]) if k < depth else F.lit(0).cast("long")).alias(f"r{k}") for k in range(LEVELS)]]


ROOT = ["depth", *[f"r{k}" for k in range(LEVELS)]]


def _roots_and_searches(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each vector of counts that occurs: the node that holds it, and the nodes within the budget.

    A node holds its words if they are at most LARGEST, else its children do; on the last
    level it holds them whatever their number. Both are found level by level.
    """
    vectors = cut_lineage(words.groupBy(*_LEVEL).agg(F.count("*").alias("_words")))
    sizes = [cut_lineage(vectors.groupBy(*_LEVEL[: d + 1]).agg(F.sum("_words").alias("_size"))) for d in range(LEVELS)]
    budget = vectors.select(*_LEVEL, "_words", F.lit(1).alias("_surplus"), F.lit(1).alias("_deficit"))
    own, held, reached = vectors.select(*_LEVEL), [], []
    for d in range(LEVELS):
        last = d == LEVELS - 1
        held_here = F.lit(True) if last else F.col("_size") <= LARGEST
        at = own.join(sizes[d], _LEVEL[: d + 1])
        held.append(at.where(held_here).select(*_LEVEL, *_root_key(d + 1, _LEVEL), (F.col("_size") > LARGEST).alias("hot")))
        own = at.where(~held_here).select(*_LEVEL)
        tried = budget.withColumn("_c", F.explode(_changes()))
        tried = tried.withColumn("_surplus", F.col("_surplus") - F.col("_c.surplus")).withColumn("_deficit", F.col("_deficit") - F.col("_c.deficit"))
        tried = tried.where("_surplus >= 0 and _deficit >= 0").withColumn(f"t{d}", F.col(f"v{d}") + F.col("_c.add")).drop("_c")
        named = sizes[d].withColumnsRenamed({f"v{k}": f"t{k}" for k in range(d + 1)})
        there = cut_lineage(tried.join(named, [f"t{k}" for k in range(d + 1)]))
        reached.append(there.where(held_here).select(*_LEVEL, "_words", *_root_key(d + 1, [f"t{k}" for k in range(LEVELS)]), (F.col("_size") > LARGEST).alias("hot")))
        budget = there.where(~held_here).drop("_size")
    union = lambda parts: cut_lineage(_union(parts))
    return union(held), union(reached)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes one word of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


class _Letters:
    """Words of up to LETTERS letters as rows of code points, from the left and from the right."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        width = int(min(self.size.max(initial=1), LETTERS))
        grid = lambda cut: np.frombuffer("".join(cut).encode("utf-32-le"), np.uint32).reshape(len(words), width)
        self.left = grid([w[:width].ljust(width, "\0") for w in words])
        self.right = grid([w[-width:][::-1].ljust(width, "\0") for w in words])


def _equal_ahead(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many columns agree before the first that does not."""
    width = min(a.shape[1], b.shape[1])
    other = a[:, :width] != b[:, :width]
    return np.where(other.any(axis=1), other.argmax(axis=1), width)


def _verified(a: _Letters, i: np.ndarray, b: _Letters, j: np.ndarray) -> np.ndarray:
    """Whether words a[i] and b[j] are one edit apart: what agrees from the left and from the right leaves one letter."""
    low, high = np.minimum(a.size[i], b.size[j]), np.maximum(a.size[i], b.size[j])
    ahead, behind = _equal_ahead(a.left[i], b.left[j]), _equal_ahead(a.right[i], b.right[j])
    ahead, behind = np.minimum(ahead, low), np.minimum(behind, low)
    near = (high - low <= 1) & (ahead + behind >= high - 1) & ((high != low) | (ahead < low))
    for k in np.flatnonzero(high > LETTERS).tolist():
        near[k] = one_edit(a.words[i[k]], b.words[j[k]])
    return near


class Trie:
    """Words by their letter-group counts, one level for each group."""

    def __init__(self, words: list[str]) -> None:
        counts = letter_counts(words)
        order = np.lexsort(counts.T[::-1])
        self.counts, self.words = counts[order].astype(np.int32), [words[i] for i in order.tolist()]
        self.letters, self.place = _Letters(self.words), order

    def search(self, asked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of asked words and of words here that are one edit apart."""
        own, letters = letter_counts(asked).astype(np.int32), _Letters(asked)
        budget = np.ones(len(asked), np.int32)
        near, leaves, held = [(np.zeros(0, np.int64),) * 2], [], 0
        for leaf in self._visit(0, 0, len(self.words), np.arange(len(asked)), budget, budget, own):
            leaves.append(leaf)
            held += len(leaf[0])
            if held >= PAIRS:
                near.append(self._near(letters, leaves))
                leaves, held = [], 0
        near.append(self._near(letters, leaves))
        return tuple(np.concatenate(x) for x in zip(*near, strict=True))

    def _near(self, letters: _Letters, leaves: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        k, e = (np.concatenate([np.zeros(0, np.int64), *(leaf[side] for leaf in leaves)]) for side in (0, 1))
        good = _verified(letters, k, self.letters, e)
        return k[good], self.place[e[good]]

    def _visit(self, level, low, high, q, surplus, deficit, own) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Depth first: the searches that reach a node go on to the children their budgets allow.

        Where few words and searches are left, their remaining levels are compared at once.
        """
        if level == GROUPS or len(q) * (high - low) <= FEW:
            k, e = np.repeat(np.arange(len(q)), high - low), np.tile(np.arange(low, high), len(q))
            if level < GROUPS:
                delta = self.counts[e, level:] - own[q[k], level:]
                total, size = delta.sum(axis=1), np.abs(delta).sum(axis=1)
                fits = (size + total <= 2 * surplus[k]) & (size - total <= 2 * deficit[k])
                k, e = k[fits], e[fits]
            if len(k):
                yield q[k], e
            return
        column = self.counts[low:high, level]
        edges = np.flatnonzero(np.diff(column, prepend=-1))
        wanted = own[q, level]
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), high - low], strict=True):
            delta = column[a] - wanted
            more, less = surplus - (delta == 1), deficit - (delta == -1)
            go = np.flatnonzero((np.abs(delta) <= 1) & (more >= 0) & (less >= 0))
            if len(go):
                yield from self._visit(level + 1, low + a, low + b, q[go], more[go], less[go], own)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node, share and kind: a node's words (kind 0), then the words that search it."""
    key, words, counts, trie = None, [], [], None
    for batch in batches:
        names = [*ROOT, "share"]
        keys = np.stack([batch.column(c).to_numpy() for c in names] + [batch.column("kind").to_numpy()], axis=1)
        edges = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else []
        text, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        found = []
        for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
            here, kind = tuple(keys[a, :-1].tolist()), keys[a, -1]
            if here != key:
                key, words, counts, trie = here, [], [], None
            if kind == 0:
                words += text[a:b]
                counts += n[a:b].tolist()
                continue
            trie = trie or Trie(words)
            k, e = (x.tolist() for x in trie.search(text[a:b]))
            found += [(text[a + i], int(n[a + i]), words[j], counts[j]) for i, j in zip(k, e, strict=True)]
        columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _NEAR.types, strict=True)], schema=_NEAR)


_NEAR = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def _without_one(word: str) -> Column:
    """The word without its first, second, .. letter."""
    cut = lambda i: F.concat(F.substring(F.col(word), F.lit(1), i), F.substring(F.col(word), i + 2, F.length(word)))
    return F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda i: F.struct(i.alias("at"), cut(i).alias("rest")))


def _by_deletion(asked: DataFrame, held: DataFrame) -> DataFrame:
    """Near pairs by equal remains after one deletion, for nodes of any size.

    Words that lack the same letter place and are equal otherwise are each other's
    replacements, so a key brings together no more words than there are letters.
    """
    def keys(df: DataFrame, longer: str, shorter: str) -> DataFrame:
        cut = df.select("word", "n", F.explode(_without_one("word")).alias("c"))
        same = cut.select("word", "n", F.concat(F.lit("same"), F.col("c.at").cast("string")).alias("how"), F.col("c.rest").alias("key"))
        return same.unionByName(cut.select("word", "n", F.lit(longer).alias("how"), F.col("c.rest").alias("key"))).unionByName(
            df.select("word", "n", F.lit(shorter).alias("how"), F.col("word").alias("key"))
        ).distinct()

    right = keys(held, "held longer", "asked longer").withColumnsRenamed({"word": "near", "n": "near_n"})
    left = keys(asked, "asked longer", "held longer")
    return left.join(right, ["how", "key"]).where("word != near").select("word", "n", "near", "near_n").distinct()


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n``: both directions of every pair of words that are one edit apart.

    ``words`` has distinct ``word`` and ``n``. The trie of letter-group counts is cut at nodes
    of at most LARGEST words; each word goes to the nodes that a surplus and a deficit of
    one reach, where the rest of the trie is searched depth first and leaf words are
    verified. A leaf of more words than that, which no count can split, is joined by the
    remains of deletions instead. Searches of one node are dealt out beyond SEARCHES.
    """
    table = cut_lineage(words.mapInArrow(_with_counts, f"word string, n long, {', '.join(f'{v} long' for v in _LEVEL)}"))
    roots, reached = _roots_and_searches(table)
    loads = reached.where("not hot").groupBy(*ROOT).agg(F.sum("_words").alias("_load"))
    shares = cut_lineage(loads.select(*ROOT, F.ceil(F.col("_load") / SEARCHES).cast("int").alias("_shares")))
    held = table.join(roots.where("not hot"), _LEVEL).join(shares, ROOT)
    held = held.select("word", "n", *ROOT, F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("share"), F.lit(0).alias("kind"))
    asked = table.join(reached.where("not hot").join(shares, ROOT).drop("_words"), _LEVEL)
    asked = asked.select("word", "n", *ROOT, F.pmod(F.xxhash64("word"), F.col("_shares")).cast("int").alias("share"), F.lit(1).alias("kind"))
    both = held.unionByName(asked).repartition(*ROOT, "share").sortWithinPartitions(*ROOT, "share", "kind")
    near = both.mapInArrow(_search, "word string, n long, near string, near_n long")
    if roots.where("hot").limit(1).count():
        many = table.join(roots.where("hot"), _LEVEL).select("word", "n")
        asking = table.join(reached.where("hot").select(*_LEVEL).distinct(), _LEVEL, "left_semi").select("word", "n")
        near = near.unionByName(_by_deletion(asking, many))
    return near


def spelling_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """The usual form of every word that has one, and how many words are near it.

    ``words`` has ``word`` and ``n``, how often it occurs, as :func:`log_words` gives them;
    a NULL word is left out, other columns are ignored, and counts of a repeated word are
    added up. Two words are near if exactly one inserted, deleted or replaced code point
    makes one of the other. The result has one row per word: ``word``; ``form``, its near
    word of largest n, among equal ones the first in code-point order, if that n is at
    least ``ratio`` times its own, else NULL; ``root``, where following forms ends, the word
    itself without a form; ``n``; ``n_near``; ``form_n``.
    """
    distinct = cut_lineage(words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    near = near_words(distinct).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    )
    named = distinct.join(near, "word", "left")
    usual = -F.col("best.less") >= F.col("n") * ratio
    judged = cut_lineage(named.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(usual, F.col("best.near")).alias("form"), F.when(usual, -F.col("best.less")).alias("form_n"),
    ))
    links = judged.where("form is not null").select("word", F.col("form").alias("root"))
    top = judged.agg(F.max("n")).first()[0] or 1
    steps = math.ceil(math.log(max(top, 2), max(ratio, 2))) + 1  # each form occurs ratio times as often as its word
    for _ in range(math.ceil(math.log2(steps + 1))):
        further = links.select(F.col("word").alias("_at"), F.col("root").alias("_root"))
        links = cut_lineage(links.join(further, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_root", "root").alias("root")))
    return judged.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
