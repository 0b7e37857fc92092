"""Source divergence audit by chunk factorization.

How far do the sources of a language differ in the words they use? Texts repeat the same
white-space chunks over and over, so the words are taken from each distinct chunk once:

1. *Chunks*. Each task counts the chunks of its documents (documents that hold
   the chunk, and occurrences) per language and source; the partial counts are dealt out by chunk.
2. *Tokens*. In its partition each globally distinct chunk is tokenized once; its terms join its counts
   there, and are summed per term before they move on.
3. *Terms*. A term's occurrences are exact sums over its chunks. Its
   documents are not, since a document can hold one term in two chunks ("Word," and "word"), but
   they lie between the largest count of one of its chunks and the sum of all, source by source.
4. *Distinct documents*. Only terms whose two bounds lie on different sides of ``min_docs``
   are counted anew: a bit map of fixed size of their chunks goes with the tasks, the
   documents' chunks that it lets pass are joined with the terms and counted as distinct
   (document, term). The bit map only saves rows; its false hits fall out of the join.
5. *Divergence*. Smoothed shares of the kept terms in integers (``SCALE`` is 1), compared between
   the sources of a language and between a source and its language. The tasks sum over their
   terms, a matrix of sources per language, and hand on their strongest terms of each source; only these are shuffled.

A language's figures join its terms with a salt, so a language with most of the rows is dealt to many tasks.

Defined results: null text, lang and source count as ''; a document without terms adds its
(lang, source) group only; a group without terms has every kept term with count 0; a language
without kept terms has pairs of value 0 and no terms; repeated rows count as documents of their own;
an empty table gives no rows. Other columns are never read, doc_id neither.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import common as C
from tessera.llm import hashing as H

MIN_DOCS = 30
TOP = 50
SCALE = 1_000_000_000
ADD = 5
SALTS = 32
#: chunks that a task holds before it hands on its counts
HELD = 400_000
#: packed counts that a task gathers before it sums equal ones
GATHERED = 200_000
#: bytes of a packed count: source code, occurrences, documents
ENTRY = 24
#: the map of chunks whose documents are counted anew has 2 ** MAP_BITS bits (8 MB)
MAP_BITS = 26

#: fixed values
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: the bytes of a character outside ASCII are all above 0x7F
TERM_BYTES = re.compile(TERM.encode())
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def group_columns(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """data (bytes), lang, source, null as empty."""
    def plain(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return docs.select(plain(text).cast("binary").alias("data"), plain(lang).alias("lang"), plain(source).alias("source"))


def source_code(source: str) -> int:
    """64 bits that stand for a source while chunks are counted; ``source_names`` raises if two sources of a language share them."""
    return xxhash.xxh64_intdigest(source.encode("utf-8", "surrogatepass")) - (1 << 63)


def chunk_counts(own: DataFrame) -> DataFrame:
    """lang, chunk, counts, as the tasks counted them: ``counts`` packs (source code, occurrences, documents that hold the chunk) of each source.

    The empty chunk's counts are the names of the sources, as JSON.
    """
    columns = ["lang", "chunk", "counts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in {lang for lang, _ in groups}:
                of = {source: held for (x, source), held in groups.items() if x == lang}
                chunks = pa.chunked_array([pa.array(list(docs), pa.binary()) for docs, _ in of.values()]).combine_chunks().dictionary_encode()
                entries = np.empty((len(chunks), 3), dtype=np.int64)
                at = 0
                for source, (docs, again) in of.items():
                    k = len(docs)
                    entries[at:at + k, 0] = source_code(source)
                    entries[at:at + k, 2] = seen = np.fromiter(docs.values(), np.int64, k)
                    entries[at:at + k, 1] = seen + np.fromiter(map(again.__getitem__, docs), np.int64, k)
                    at += k
                index = chunks.indices.to_numpy()
                order = np.argsort(index, kind="stable")  # of a chunk, the sources in their order
                size = np.bincount(index, minlength=len(chunks.dictionary))
                ends = np.concatenate([[0], np.cumsum(size)]) * ENTRY
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(entries[order].tobytes())])
                yield from pa.Table.from_arrays([pa.array([lang] * len(size)), chunks.dictionary, packed.cast(pa.binary())], columns).to_batches(max_chunksize=1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([b""]), pa.array([json.dumps(list(of)).encode()])], columns)
            groups.clear()
            pa.default_memory_pool().release_unused()

        held = 0
        for batch in batches:
            for data, lang, source in zip(*(batch.column(c).to_pylist() for c in ("data", "lang", "source"))):
                docs, again = groups.get((lang, source)) or groups.setdefault((lang, source), (Counter(), Counter()))
                before = len(docs)
                own = Counter(data.split())  # bytes: at [\x20\x09-\x0D] only
                docs.update(own.keys())
                for chunk, times in own.items():
                    if times > 1:
                        again[chunk] += times - 1
                held += len(docs) - before
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    return own.mapInArrow(count, "lang string, chunk binary, counts binary")


def tokens(chunks: list[bytes]) -> list[list[bytes]]:
    """The terms of each chunk (chunks hold no white space)."""
    return list(map(TERM_BYTES.findall, b"\n".join(chunks).translate(LOWERED).split(b"\n")))


def tokenized(counts: DataFrame) -> DataFrame:
    """One table of three kinds of rows, from partial chunk counts.

    ``term``: lang, source (code), term, n (occurrences), docs (the sum over its chunks), most (the largest of them), of a partition's chunks;
    ``chunk``: lang, term, chunk, each chunk with each of its terms in each language; ``source``: lang, source, name.
    """
    names = ["kind", "lang", "source", "name", "term", "chunk", "n", "docs", "most"]
    kinds = pa.schema(list(zip(names, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))))

    def rows(kind: str, size: int, **columns) -> Iterator[pa.RecordBatch]:
        full = [pa.array([kind] * size) if f.name == "kind" else columns.get(f.name, pa.nulls(size, f.type)) for f in kinds]
        yield from pa.Table.from_arrays(full, schema=kinds).to_batches(max_chunksize=1 << 16)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # chunks, languages and sources are numbered as they come; counts of equal ones are summed as they pile up
        chunks, langs, codes, sources = pa.array([], pa.binary()), {}, {}, set()
        sums, held, size = np.zeros((0, 5), dtype=np.int64), [], 0  # language, chunk, source, occurrences, documents

        def numbered(values: pa.Array, numbers: dict) -> np.ndarray:
            coded = values.dictionary_encode()
            return np.array([numbers.setdefault(x, len(numbers)) for x in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()]

        def combined() -> tuple[pa.Array, np.ndarray]:
            coded = pa.chunked_array([chunks, *(c for c, _, _ in held)]).combine_chunks().dictionary_encode()
            at = coded.indices.to_numpy()[len(chunks):].astype(np.int64)
            many, entries = np.concatenate([m for _, m, _ in held]), np.concatenate([e for _, _, e in held])
            entries[:, 1] = np.repeat(at, many)
            every = np.concatenate([sums, entries])
            key = (every[:, 1] * len(langs) + every[:, 0]) * len(codes) + every[:, 2]
            found = pa.table({"key": key, "n": every[:, 3], "docs": every[:, 4]}).group_by("key", use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
            key, source = np.divmod(found.column("key").to_numpy(), len(codes))
            return coded.dictionary, np.stack([key % len(langs), key // len(langs), source, found.column("n_sum").to_numpy(), found.column("docs_sum").to_numpy()], axis=1)

        for batch in batches:
            named = pc.equal(pc.binary_length(batch.column("chunk")), 0)
            if pc.any(named).as_py():
                for x, own in zip(*(batch.filter(named).column(c).to_pylist() for c in ("lang", "counts"))):
                    sources.update((x, name) for name in json.loads(own))
                batch = batch.filter(pc.invert(named))
            if not batch.num_rows:
                continue
            packed = batch.column("counts")
            many = pc.binary_length(packed).to_numpy(zero_copy_only=False).astype(np.int64) // ENTRY
            first = int(np.frombuffer(packed.buffers()[1], np.int32)[packed.offset])
            given = np.frombuffer(packed.buffers()[2], np.int64, count=3 * int(many.sum()), offset=first).reshape(-1, 3)
            entries = np.empty((len(given), 5), dtype=np.int64)
            entries[:, 0] = np.repeat(numbered(batch.column("lang"), langs), many)
            entries[:, 2] = numbered(pa.array(np.ascontiguousarray(given[:, 0])), codes)
            entries[:, 3:] = given[:, 1:]
            held.append((pa.concat_arrays([batch.column("chunk")]), many, entries))
            size += len(entries)
            if size > GATHERED:
                (chunks, sums), held, size = combined(), [], 0
                pa.default_memory_pool().release_unused()
        if sources:
            of = sorted(sources)
            yield from rows("source", len(of), lang=pa.array([x for x, _ in of]), source=pa.array([source_code(s) for _, s in of]), name=pa.array([s for _, s in of]))
        if held:
            chunks, sums = combined()
        if not len(sums):
            return
        known, code_of = pa.array(list(langs)), np.array(list(codes), dtype=np.int64)
        lang, at, source, n, docs = sums.T
        numbers = chunks.to_pylist()
        words = tokens(numbers)  # each distinct chunk once
        repeated = {k: Counter(f) for k, f in enumerate(words) if len(f) > 1 and len(set(f)) < len(f)}
        for k, f in repeated.items():
            words[k] = list(f)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        flat = pa.array([t for f in words for t in f], pa.binary()).dictionary_encode()
        times = np.ones(len(flat), dtype=np.int64)
        for k, f in repeated.items():
            times[starts[k]:starts[k] + sizes[k]] = list(f.values())
        term_of = flat.indices.to_numpy()
        # each row of counts with each term of its chunk
        each = np.repeat(np.arange(len(at)), sizes[at])
        place = np.arange(len(each)) - np.repeat(np.cumsum(sizes[at]) - sizes[at], sizes[at]) + starts[at][each]
        spread = pa.table({"lang": lang[each], "source": source[each], "term": term_of[place], "n": n[each] * times[place], "docs": docs[each]})
        terms = spread.group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum"), ("docs", "max")])
        yield from rows("term", terms.num_rows, lang=known.take(terms.column("lang")), source=pa.array(code_of[terms.column("source").to_numpy()]), term=flat.dictionary.take(terms.column("term")),
                        n=terms.column("n_sum"), docs=terms.column("docs_sum"), most=terms.column("docs_max"))
        of, place = np.divmod(np.unique(lang[each] * max(1, len(flat)) + place), max(1, len(flat)))
        owner = np.repeat(np.arange(len(words)), sizes)[place]
        yield from rows("chunk", len(place), lang=known.take(pa.array(of)), term=flat.dictionary.take(pa.array(term_of[place])),
                        chunk=chunks.take(pa.array(owner)))

    # counted in the tasks already: no partial aggregate before the shuffle
    spread = counts.repartition("chunk").mapInArrow(work, "kind string, lang string, source long, name string, term binary, chunk binary, n long, docs long, most long")
    return spread.withColumn("term", F.col("term").cast("string"))


def source_names(rows: DataFrame) -> DataFrame:
    """lang, source (code), name; raises when the query runs if two sources of a language share a code."""
    found = rows.where("kind = 'source'").groupBy("lang", "source").agg(F.min("name").alias("name"), F.max("name").alias("other"))
    one = F.when(F.col("name") != F.col("other"), F.raise_error(F.lit("two sources share a code")).cast("string")).otherwise(F.col("name"))
    return found.select("lang", "source", one.alias("name"))


def term_bounds(rows: DataFrame) -> DataFrame:
    """lang, term, sources (source code, n), least and most documents of each term, from the ``term`` rows."""
    # summed per partition already: no partial aggregate before the shuffle
    rows = rows.where("kind = 'term'").select("lang", "source", "term", "n", "docs", "most").repartition("lang", "term").groupBy("lang", "term", "source")
    rows = rows.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.max("most").alias("most"))
    return rows.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("sources"), F.sum("most").alias("least"), F.sum("docs").alias("most"))


def bit_of(word_hash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte of the map and the bit in it."""
    bit = word_hash >> H.U64(64 - MAP_BITS)
    return (bit >> H.U64(3)).astype(np.int64), np.uint8(1) << (bit & H.U64(7)).astype(np.uint8)


def bit_map(chunks: DataFrame) -> np.ndarray:
    """A map of ``2 ** MAP_BITS`` bits in which the bits of all given chunks are set; fixed in size."""
    def bits(batches):
        for batch in batches:
            at, bit = bit_of(np.concatenate([*H.text_words(batch.column("chunk").to_pylist(), H.TABLE)]))
            found = np.zeros(1 << MAP_BITS - 3, dtype=np.uint8)
            np.bitwise_or.at(found, at, bit)
            packed = found.view(np.uint64)
            at = np.flatnonzero(packed)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed[at].view(np.int64), pa.int64())], ["at", "bits"])

    rows = chunks.mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most 2 ** (MAP_BITS - 6) rows
    packed = np.zeros(1 << MAP_BITS - 6, dtype=np.int64)
    packed[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return packed.view(np.uint8)


def distinct_documents(own: DataFrame, doubtful: DataFrame) -> DataFrame:
    """lang, term, docs of the doubtful (lang, chunk, term) rows, document by document."""
    known = bit_map(doubtful.select("chunk").distinct())  # of fixed size; goes with the function

    def passing(batches):
        for batch in batches:
            ids, langs, datas = (batch.column(c) for c in ("row", "lang", "data"))
            datas = datas.to_pylist()
            rows, found = [], []
            for k, hashes in enumerate(H.text_words(datas, H.TABLE)):
                byte, bit = bit_of(hashes)
                hit = np.flatnonzero(known[byte] & bit)
                if len(hit):
                    words = datas[k].split()
                    mine = {words[i] for i in hit.tolist()}
                    rows += [k] * len(mine)
                    found += mine
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), langs.take(at), pa.array(found, pa.binary())], ["row", "lang", "chunk"])

    numbered = own.select(F.monotonically_increasing_id().alias("row"), "lang", "data")
    rows = numbered.mapInArrow(passing, "row long, lang string, chunk binary").join(doubtful, ["lang", "chunk"])
    return rows.select("row", "lang", "term").distinct().groupBy("lang", "term").agg(F.count(F.lit(1)).alias("docs"))


def kept_terms(own: DataFrame, scratch: C.Scratch, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """lang, source (code), name of all groups, and lang, term, sources (source, n) of the terms in at least ``min_docs`` documents of the language."""
    rows = scratch.write(tokenized(chunk_counts(own)), "tokenized")
    terms = scratch.write(term_bounds(rows).where(F.col("most") >= min_docs), "terms")
    undecided = terms.where(F.col("least") < min_docs).select("lang", "term")
    holders = rows.where("kind = 'chunk'").select("lang", "chunk", "term").join(undecided, ["lang", "term"], "left_semi")
    exact = distinct_documents(own, scratch.write(holders, "doubtful"))
    kept = terms.join(exact, ["lang", "term"], "left").where((F.col("least") >= min_docs) | (F.col("docs") >= min_docs))
    return source_names(rows), scratch.write(kept.select("lang", "term", "sources"), "kept")


def shares(counts: np.ndarray, totals, size: int) -> np.ndarray:
    """1 + floor(SCALE * (count + ADD) / (total + ADD * size)), exactly: in Python's integers where 64 bits do not hold the product."""
    if len(counts) and int(counts.max()) >= (1 << 63) // SCALE - ADD:
        totals = np.broadcast_to(totals, counts.shape).tolist()
        return np.array([1 + SCALE * (n + ADD) // (t + ADD * size) for n, t in zip(counts.tolist(), totals)], dtype=np.int64)
    return 1 + SCALE * (counts + ADD) // (totals + ADD * size)


def divergences(kept: DataFrame, per_lang: DataFrame, top: int) -> DataFrame:
    """Two kinds of rows.

    ``pair``: lang, source, other, value: the differences of shares of each two sources, summed over a task's terms in a matrix per language;
    ``term``: lang, source, term, value: of the terms that a source uses more than its language, a task's ``top`` of each source.
    """
    names = ["part", "lang", "source", "other", "term", "value"]
    kinds = pa.schema(list(zip(names, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices: dict = {}
        best: dict = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            which = langs.indices.to_numpy()
            for number, lang in enumerate(langs.dictionary.to_pylist()):
                part = batch.filter(pa.array(which == number))
                figures = part.column("figures")[0].as_py()  # the same in each row of a language
                codes = np.array([f["source"] for f in figures], dtype=np.int64)  # ascending
                totals, size = np.array([f["total"] for f in figures], dtype=np.int64), figures[0]["v"]
                matrix = matrices.setdefault(lang, (codes, np.zeros((len(codes), len(codes)), dtype=np.int64)))[1]
                own, terms = part.column("sources"), part.column("term")
                long = pc.list_value_length(own).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = own.flatten()
                n, at = flat.field("n").to_numpy(), np.searchsorted(codes, flat.field("source").to_numpy())
                row = np.repeat(np.arange(len(long)), long)
                p = shares(n, totals[at], size)
                q = shares(np.add.reduceat(n, np.cumsum(long) - long), totals.sum(), size)
                step = max(1, (1 << 20) // len(codes))
                for lo in range(0, len(long), step):
                    inside = (row >= lo) & (row < lo + step)
                    dense = np.tile(shares(np.zeros(len(codes), dtype=np.int64), totals, size), (min(step, len(long) - lo), 1))
                    dense[row[inside] - lo, at[inside]] = p[inside]
                    for a in range(len(codes)):
                        matrix[a] += np.abs(dense - dense[:, a:a + 1]).sum(axis=0)
                over = p - q[row]
                for a in range(len(codes)):
                    mine = np.flatnonzero((at == a) & (over > 0))
                    if len(mine) > top:  # those as strong as the last that is wanted
                        mine = mine[over[mine] >= np.partition(over[mine], -top)[-top]]
                    if len(mine):
                        words = terms.take(pa.array(row[mine])).to_pylist()
                        found = best.setdefault((lang, int(codes[a])), [])
                        found += [(-int(v), w.encode("utf-8", "surrogatepass"), w) for v, w in zip(over[mine], words)]
                        if len(found) > 8 * top:
                            best[lang, int(codes[a])] = sorted(found)[:top]
        for lang, (codes, matrix) in matrices.items():
            n = len(codes)
            yield pa.RecordBatch.from_arrays([pa.array(["pair"] * (n * n)), pa.array([lang] * (n * n)), pa.array(np.repeat(codes, n)), pa.array(np.tile(codes, n)),
                                              pa.nulls(n * n, pa.string()), pa.array(matrix.ravel())], schema=kinds)
        for (lang, code), found in best.items():
            found = sorted(found)[:top]
            n = len(found)
            yield pa.RecordBatch.from_arrays([pa.array(["term"] * n), pa.array([lang] * n), pa.array([code] * n), pa.nulls(n, pa.int64()),
                                              pa.array([t for _, _, t in found]), pa.array([-less for less, _, _ in found])], schema=kinds)

    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")
    dealt = per_lang.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = kept.withColumn("salt", salt).join(dealt, ["lang", "salt"]).select("lang", "term", "sources", "figures")
    return rows.mapInArrow(total, "part string, lang string, source long, other long, term string, value long")


def audit(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others (``pair``) and the terms it overuses (``term``)."""
    scratch = C.Scratch(spark, "source-audit")
    groups, kept = kept_terms(group_columns(docs, text, lang, source), scratch, min_docs)
    totals = kept.select("lang", F.explode("sources").alias("s")).groupBy("lang", "s.source").agg(F.sum("s.n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    figures = scratch.write(groups.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "v"]), "figures")
    per_lang = figures.where("v > 0").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total", "v"))).alias("figures"))  # one a source
    found = scratch.write(divergences(kept, per_lang, top), "divergences")

    sums = found.where("part = 'pair'").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    named = figures.select("lang", "source", F.col("name").alias("of"))
    others = figures.select("lang", F.col("source").alias("other"), F.col("name").alias("item"))
    pairs = named.join(others, "lang").where("source <> other").join(sums, ["lang", "source", "other"], "left").withColumn("part", F.lit("pair"))
    pairs = pairs.select("lang", F.col("of").alias("source"), "part", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    terms = found.where("part = 'term'").select("lang", "source", "part", F.col("term").alias("item"), "value").join(named, ["lang", "source"])
    terms = terms.select("lang", F.col("of").alias("source"), "part", "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    return pairs.unionByName(terms).withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
