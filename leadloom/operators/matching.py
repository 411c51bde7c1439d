"""Match queries with company directories and job postings, and domains with companies.

Texts are dealt into shards, once; a task holds the inverted index of its shard, and the different
word sets of the queries are streamed past it. So a text is shuffled once however many queries
there are, a word set once for each shard, and a shard hands on only its best ``k`` or its counts.
A popular word stands for very many (text, query) pairs; those are never written out. No query
passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from leadloom.functions import text as X, urls as U
from leadloom.operators.scoring import top_n

#: Bytes of words that one task indexes.
SHARD_BYTES = 32 << 20
#: Postings of query words that a task keeps ready.
_READY = 1 << 22


def _words(text: Column) -> Column:
    """Different words of a text in lower case."""
    return F.array_distinct(F.split(X.strip(F.lower(text)), r"(?U)\s+"))


def word_sets(queries: DataFrame, key: str, column: str, min_length: int) -> DataFrame:
    """``key``, ``_set`` and ``_k``: the different words of a key's rows, sorted, with blanks
    between, and the least key that has the same set, which stands for it.

    Words have no white space, so equal sets are equal texts.
    """
    each = queries.select(key, F.explode_outer(F.filter(
        _words(F.col(column)), lambda w: F.length(w) >= min_length)).alias("_w"))
    sets = each.groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_set("_w")), " ").alias("_set"))
    return sets.withColumn("_k", F.min(key).over(W.partitionBy("_set")))


def _shards(texts: DataFrame, size: Column, shard_bytes: int) -> int:
    """How many shards hold the texts, whose sizes in bytes are summed in one pass."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = texts.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).head()["bytes"]
    return max(parts, -(-total // shard_bytes))


def _met(texts: DataFrame, sets: DataFrame, key: str, order: list[str],
         shards: int) -> DataFrame:
    """Texts and word sets, sorted by ``_shard``: first its texts in ``order``, then all sets.

    Every text is in one shard, every different set, under its least key, in all of them.
    """
    dealt = texts.withColumns({
        "_shard": F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int"),
        "_set": F.lit(None).cast("string")})
    asked = sets.filter(F.col(key).eqNullSafe(F.col("_k"))).drop(key).withColumn(
        "_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return dealt.unionByName(asked, allowMissingColumns=True).repartition(
        shards, "_shard").sortWithinPartitions("_shard", F.col("_set").isNotNull(), *order)


def _by_shard(columns: list[str], index: Callable, answer: Callable):
    """Task function over rows of ``_met``: ``index(rows)`` of a shard's texts, then
    ``answer(index, sets, keys)`` for batches of its sets, which gives record batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, built = None, [], None
        for b in batches:
            shards = b.column("_shard").to_numpy(zero_copy_only=False)
            cuts = np.nonzero(np.diff(shards))[0] + 1
            for start, end in zip([0, *cuts], [*cuts, len(shards)]):
                if start == end:
                    continue
                if shards[start] != shard:
                    shard, held, built = shards[start], [], None
                part = b.slice(start, end - start)
                sets = part.column("_set")
                n_texts = sets.null_count
                if n_texts:
                    held.append(part.slice(0, n_texts).select(columns))
                if n_texts < len(sets):
                    if built is None and held:
                        built = index(pa.Table.from_batches(held))
                        held = []
                    if built is not None:
                        yield from answer(built, sets.slice(n_texts).to_pylist(),
                                          part.column("_k").slice(n_texts))

    return run


class _Directory:
    """Impact-ordered lists of a shard's companies: for each word that is asked for, the companies
    with it and what it is worth there, and the most that it is worth anywhere.

    A word stands in a text if it is a part of one of its words; those are found among the
    shard's different words by the rarest three letters in a row.
    """

    def __init__(self, rows: pa.Table):
        self.keys = rows.column("_c").combine_chunks()
        self.base = rows.column("_base").to_numpy().astype(np.int64)
        self.most_base = int(self.base.max(initial=0))
        self.by_base = np.lexsort((np.arange(len(self.base)), -self.base))
        held: dict[str, tuple[list, list]] = {}
        texts = (rows.column(c).to_pylist() for c in ("_name", "_one", "_all"))
        for at, (name, one, whole) in enumerate(zip(*texts)):
            worth = dict.fromkeys(whole.split(" "), 1)
            worth |= dict.fromkeys(one.split(" "), 2)
            worth |= dict.fromkeys(name.split(" "), 4)
            for w, points in worth.items():
                ids, points_of = held.setdefault(w, ([], []))
                ids.append(at)
                points_of.append(points)
        self.words = list(held)
        self.held = [(np.array(i, np.int64), np.array(p, np.int64)) for i, p in held.values()]
        self.parts: dict[str, list[int]] = {}
        for n, w in enumerate(self.words):
            for p in {w[i:i + 3] for i in range(len(w) - 2)}:
                self.parts.setdefault(p, []).append(n)
        self.ready: dict[str, tuple] = {}
        self.n_ready = 0

    def worth(self, word: str) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Companies with the word, in order, its points there, and the most points."""
        if word in self.ready:
            return self.ready[word]
        some = min((self.parts.get(word[i:i + 3], ()) for i in range(len(word) - 2)), key=len)
        lists = [self.held[n] for n in some if word in self.words[n]]
        out = None
        if lists:
            ids, points = (np.concatenate(x) for x in zip(*lists))
            if len(lists) > 1:
                order = np.lexsort((-points, ids))
                ids, first = np.unique(ids[order], return_index=True)
                points = points[order][first]
            out = ids, points, int(points.max())
            self.n_ready += len(ids)
        if self.n_ready > _READY:
            self.ready, self.n_ready = {}, len(out[0]) if out else 0
        self.ready[word] = out
        return out

    def best(self, words: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` companies and their points, ties to the smaller key (MaxScore).

        Lists are read from the shortest on. As soon as all that the lists left can give is less
        than the ``k``-th best has, they bring no new companies and are only looked up.
        """
        lists = sorted(filter(None, map(self.worth, words)), key=lambda x: len(x[0]))
        left = np.cumsum([0, *(most for _, _, most in reversed(lists))])[::-1].tolist()
        at = self.by_base[:k]
        at = np.sort(at)
        points, least, new = self.base[at], -1, True
        for (ids, more, _), rest in zip(lists, left):
            if new and rest + self.most_base < least:
                new = False
            if new:
                got = np.concatenate([at, ids])
                both = np.concatenate([points, more + self.base[ids]])
                order = np.argsort(got, kind="stable")
                got, both = got[order], both[order]
                first = np.nonzero(np.concatenate([[True], got[1:] != got[:-1]]))[0]
                at, total = got[first], np.add.reduceat(both, first)
                # Their own points were added twice where both had the company.
                points = total - self.base[at] * (np.diff(np.append(first, len(got))) - 1)
            else:
                keep = points + rest >= least
                at, points = at[keep], points[keep]
                place = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
                points = points + np.where(ids[place] == at, more[place], 0)
            if len(points) >= k:
                least = int(np.partition(points, len(points) - k)[len(points) - k])
        some = np.nonzero(points > 0)[0]
        if len(some) > k:
            some = some[points[some] >= least]
        some = some[np.lexsort((at[some], -points[some]))[:k]]
        return at[some], points[some]


def _best_of_shard(k: int):
    def answer(index: _Directory, sets: list[str], keys: pa.Array) -> Iterator[pa.RecordBatch]:
        found = [index.best(s.split(" ") if s else [], k) for s in sets]
        at, points = (np.concatenate(x) for x in zip(*found))
        each = np.repeat(np.arange(len(sets)), [len(a) for a, _ in found])
        yield pa.RecordBatch.from_arrays(
            [keys.take(pa.array(each)), index.keys.take(pa.array(at)), pa.array(points)],
            ["_k", "_c", "score"])

    return _by_shard(["_c", "_base", "_name", "_one", "_all"], _Directory, answer)


def directory_match(companies: DataFrame, queries: DataFrame, k: int, company_key: str = "slug",
                    key: str = "query_id", column: str = "query",
                    shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Best ``k`` directory companies per query, rank 1 = best.

    Each query word of three letters or more gives 4 points when it is in the name, else 2 in
    the one-liner, else 1 anywhere; a hiring company and an active one get one point more.
    Every shard hands on at most ``k`` companies per different word set.
    """
    def words(*columns: Column) -> Column:
        return F.array_join(_words(F.concat_ws(" ", *columns)), " ")

    low = lambda c: F.coalesce(F.col(c), F.lit(""))
    base = F.coalesce(F.col("is_hiring").cast("int"), F.lit(0)) + F.coalesce(
        (F.col("status") == "Active").cast("int"), F.lit(0))
    texts = companies.select(
        F.col(company_key).cast("string").alias("_c"), base.alias("_base"),
        words(low("name")).alias("_name"), words(low("one_liner")).alias("_one"),
        words(low("long_description"), F.array_join(F.coalesce("tags", F.array()), " ")).alias("_all"))
    sets = word_sets(queries, key, column, 3)
    size = sum((F.octet_length(low(c)) for c in ("one_liner", "long_description")),
               F.octet_length(low("name")))
    found = _met(texts, sets, key, ["_c"], _shards(companies, size, shard_bytes)).mapInArrow(
        _best_of_shard(k), f"_k {_kind(queries, key)}, _c string, score long")
    best = top_n(found, ["_k"], [F.desc("score"), F.asc("_c")], k, "rank")
    return _of_keys(best, sets, key).join(
        companies, F.col("_c") == companies[company_key]).drop("_c")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _of_keys(found: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """What was found for a set, for each key that has it."""
    keys = sets.select(key, F.col("_k").alias("_of"))
    return found.join(keys, F.col("_k").eqNullSafe(F.col("_of"))).drop("_k", "_of")


def directory_result(matched: DataFrame) -> DataFrame:
    """Search-result fields of matched directory companies."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    described = F.coalesce(F.nullif(text("one_liner"), F.lit("")),
                           F.substring(text("long_description"), 1, 200))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    blank = lambda c: F.nullif(c, F.lit(""))
    return matched.withColumns({
        "title": text("name"),
        "href": F.coalesce(blank(F.col("url")),
                           F.concat(F.lit("https://"), text("slug"), F.lit(".com"))),
        "body": F.concat_ws(
            " | ", blank(described),
            F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "))),
            F.when(text("batch") != "", F.concat(F.lit("YC "), "batch"))),
    })


class _Postings:
    """The postings of a shard by word, in the order of slugs and posting keys."""

    def __init__(self, rows: pa.Table):
        slugs = rows.column("slug").to_pylist()
        self.p, self.role = (rows.column(c).combine_chunks() for c in ("_p", "_role"))
        held: dict[str, list[int]] = {}
        for at, words in enumerate(rows.column("_words").to_pylist()):
            for w in words.split(" "):
                held.setdefault(w, []).append(at)
        self.held = {w: np.array(ids, np.int64) for w, ids in held.items()}
        self.starts = np.array([i for i, s in enumerate(slugs) if not i or s != slugs[i - 1]], int)
        self.slugs = np.array([slugs[i] for i in self.starts], object)
        self.n = len(slugs)

    def hits(self, words: list[str]) -> np.ndarray:
        hit = np.zeros(self.n, bool)
        for w in words:
            if w in self.held:
                hit[self.held[w]] = True
        return hit


def _counts_of_shard(roles: int, max_slugs: int | None):
    """The first row of a set and slug carries the shard's count, and there are at most ``roles``.

    Of the ``max_slugs`` first slugs of a set, each is among the first in every shard it is in.
    """
    def answer(index: _Postings, sets: list[str], keys: pa.Array) -> Iterator[pa.RecordBatch]:
        asked, at, counts, size = [], [], [], 0
        for n, s in enumerate(sets):
            hit = index.hits(s.split(" "))
            found = np.nonzero(hit)[0]
            if not len(found):
                continue
            slug = np.searchsorted(index.starts, found, "right") - 1
            first = np.nonzero(np.concatenate([[True], slug[1:] != slug[:-1]]))[0][:max_slugs]
            many = np.diff(np.append(first, len(found))) if max_slugs is None or len(first) < max_slugs else \
                np.diff(np.append(first, np.searchsorted(slug, slug[first[-1]], "right")))
            some = np.minimum(many, roles)
            place = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
            at.append(found[np.repeat(first, some) + place])
            counts.append(np.where(place == 0, np.repeat(many, some), 0))
            asked.append(np.full(some.sum(), n))
            size += len(at[-1])
            if size > 100_000:
                yield rows(index, keys, asked, at, counts)
                asked, at, counts, size = [], [], [], 0
        if size:
            yield rows(index, keys, asked, at, counts)

    def rows(index: _Postings, keys: pa.Array, asked: list, at: list,
             counts: list) -> pa.RecordBatch:
        where = np.concatenate(at)
        slug = index.slugs[np.searchsorted(index.starts, where, "right") - 1]
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(np.concatenate(asked))), pa.array(slug, pa.string()),
             index.p.take(pa.array(where)), index.role.take(pa.array(where)),
             pa.array(np.concatenate(counts))], ["_k", "slug", "_p", "_role", "_count"])

    return _by_shard(["slug", "_p", "_role", "_words"], _Postings, answer)


def job_match(postings: DataFrame, queries: DataFrame, text: Column, role: str,
              label: str = "open engineering roles", posting_key: str = "posting_id",
              key: str = "query_id", column: str = "query", roles: int = 5,
              max_slugs: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Companies (slugs) with postings that share a whole word with the query.

    Per query and slug: number of relevant postings, all postings, first roles (those of the
    smallest posting keys). A shard hands on at most ``roles`` rows per word set and slug, and only
    its first ``max_slugs`` slugs of a set if that is given.
    """
    held = postings.select(
        F.col("slug").cast("string").alias("slug"), F.col(posting_key).alias("_p"),
        F.col(role).cast("string").alias("_role"), F.array_join(_words(text), " ").alias("_words"))
    sets = word_sets(queries, key, column, 1)
    met = _met(held.filter("_words IS NOT NULL AND slug IS NOT NULL"), sets.filter("_set != ''"),
               key, ["slug", "_p"], _shards(postings, F.octet_length(text), shard_bytes))
    found = met.mapInArrow(
        _counts_of_shard(roles, max_slugs), f"_k {_kind(queries, key)}, slug string, "
        f"_p {_kind(postings, posting_key)}, _role string, _count long")
    pair = W.partitionBy("_k", "slug")
    placed = found.withColumns({
        "_at": F.row_number().over(pair.orderBy("_p", "_role")),
        "_all": F.sum("_count").over(pair)}).filter(F.col("_at") <= roles)
    merged = placed.groupBy("_k", "slug").agg(F.max("_all").alias("relevant"), F.array_compact(
        F.array(*[F.max(F.when(F.col("_at") == i, F.struct("_role"))) for i in range(1, roles + 1)])
    ).getField("_role").alias("hiring_roles"))
    if max_slugs:
        merged = top_n(merged, ["_k"], [F.asc("slug")], max_slugs, "rank")
    totals = postings.groupBy("slug").agg(F.count("*").alias("total_postings"))
    return _of_keys(merged.join(totals, "slug"), sets, key).select(
        key, "slug", "relevant", "total_postings", "hiring_roles",
        F.concat("slug", F.lit(" — "), "relevant", F.lit(f" {label}")).alias("title"),
        F.concat(F.lit("https://"), "slug", F.lit(".com")).alias("href"),
        F.array_join(F.slice("hiring_roles", 1, 3), ", ").alias("body"),
        *(["rank"] if max_slugs else []))


def match_domains(left: DataFrame, left_col: str, companies: DataFrame, company_col: str,
                  company_key: str) -> DataFrame:
    """Attach the company (smallest key) whose domain equals the left side's.

    The company side is reduced to one row per domain first, so popular domains do not
    multiply rows.
    """
    one = companies.groupBy(U.normalise_domain(company_col).alias("match_domain")).agg(
        F.min(company_key).alias("company"), F.count("*").alias("spellings"))
    return left.withColumn("match_domain", U.normalise_domain(left_col)).join(
        one, "match_domain", "left")
