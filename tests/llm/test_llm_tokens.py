"""Byte-level pieces, ORC tokens, alignment of tokenizers, collocations: brute force and round trips."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tabcascade.llm import alignment, byte_tokens, collocations, common, orc_tokens, piece_table, queries

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")

BITS = ["a", " ", "  ", "\n", "\t", " \n", "'", "'s", "'re", "'ll", "'t", "x", "é", "×", "÷", "!", "...", "12", "<|endoftext|>", "<s>", "<0x0A>", "日本", "　", "▁", "W'd", "''", "' s", "\r\n", "\x1c", "long" * 8, " " + "long" * 6]


def fuzz(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(BITS, k=rng.randrange(12))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def piece_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def split(ids, counts):
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


# ---- pieces ----------------------------------------------------------------------------


@pytest.mark.parametrize("plain_specials", [False, True])
def test_pieces_are_the_tokenizers(byte_tokenizer, data, spark, plain_specials):
    texts = fuzz(5000, 1) + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    byte_tokenizer.encode_special_tokens = plain_specials
    want = [e.ids for e in byte_tokenizer.encode_batch(texts, add_special_tokens=False)]
    byte_tokenizer.encode_special_tokens = False
    encoder = byte_tokens.ByteLevel(BYTE, plain_specials)
    assert encoder.by_piece
    for a in range(0, len(texts), 100):
        assert split(*encoder.encode([t.encode() for t in texts[a : a + 100]])) == want[a : a + 100]


@pytest.mark.parametrize("limit", [3, 60, 100_000])
def test_table_of_any_size_is_right(limit):
    rng = random.Random(limit)
    table = piece_table.PieceTable(lambda piece: np.frombuffer(piece, np.uint8).astype("<i4").tobytes(), limit)
    for _ in range(20):
        texts = [bytes(rng.choices(b"ab\0", k=rng.randrange(1, 30))) for _ in range(rng.randrange(80))]
        buffer, bounds = piece_table.padded(texts)
        ids, counts = table.ids(buffer, bounds[:-1], np.diff(bounds))
        assert ids.tolist() == list(b"".join(texts)) and counts.tolist() == [len(t) for t in texts]


def test_runs_are_the_piece_models(piece_model, spark, data):
    texts = fuzz(5000, 2) + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(40).collect()]
    texts = [t for t in texts if t and "▁" not in t]  # a sign that stands for the space itself is refused as a whole
    encoder = alignment.SpacePieces(PIECE)
    assert encoder.by_run
    for a in range(0, len(texts), 100):
        part = texts[a : a + 100]
        assert split(*encoder.encode([b" " + t.encode() for t in part])) == piece_model.encode(part)


# ---- ORC -------------------------------------------------------------------------------


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, 5, 1, [2]) for i, t in rows], "doc_id long, text string, part int, start int, ids array<int>")


def checked_rows(spark, path):
    return sorted((r.doc_id if r.doc_id is not None else -(10**9), r.start, r.n_tokens, r.ids_crc32) for r in orc_tokens.with_checksum(orc_tokens.read_tokens(spark, path)).collect())


def brute_orc(tokenizer, rows):
    lists = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for k, (_, t) in enumerate(rows)}
    return lists


def test_files_hold_the_stream(spark, byte_tokenizer):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(fuzz(400, 3))] + [(7, "again"), (7, "again"), (7, None), (1000, "é" * 30_000), (-5, "first")]
    rng.shuffle(rows)
    path = orc_tokens.new_folder(spark)
    orc_tokens.write_tokens(rows_of(spark, rows).repartition(5), path, BYTE, 2)
    got = checked_rows(spark, path)
    # starts follow from lengths in ascending order of ids; rows of one id may change places
    at, want = 0, Counter()
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(byte_tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    starts = {}
    for i in sorted(by_id):
        starts[i] = (at, at + sum(map(len, by_id[i])))
        at = starts[i][1]
        want.update((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for ids in by_id[i])
    assert Counter((i, n, c) for i, _, n, c in got) == want
    ends = sorted((s, s + n) for _, s, n, _ in got)
    assert ends[0][0] == 0 and ends[-1][1] == at and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert all(starts[i][0] <= s and s + n <= starts[i][1] for i, s, n, _ in got)


def test_reads_by_document_and_span(spark, byte_tokenizer):
    rows = [(i, f"text number {i} " * (1 + i % 7)) for i in range(600)]
    path = orc_tokens.new_folder(spark)
    orc_tokens.write_tokens(rows_of(spark, rows), path, BYTE, 2, **{"orc.stripe.size": "4096", "orc.row.index.stride": "1000"})
    every = {r.doc_id: (r.start, r.ids) for r in orc_tokens.read_tokens(spark, path).collect()}
    assert [every[i][1] for i in range(600)] == [byte_tokenizer.encode(t, add_special_tokens=False).ids + [2] for _, t in rows]
    few = orc_tokens.read_documents(spark, path, [3, 598, 9999])
    assert {r.doc_id: (r.start, r.ids) for r in few.collect()} == {i: every[i] for i in (3, 598)}
    assert "PushedFilters: [In(doc_id, [3,598,9999])" in few._jdf.queryExecution().toString()
    for start, stop in ((0, 1), (100, 2000), (every[300][0], every[300][0] + 1), (0, 10**9), (10**9, 10**9 + 1), (5, 5)):
        got = {r.doc_id for r in orc_tokens.read_span(spark, path, start, stop).collect()}
        assert got == {i for i, (s, ids) in every.items() if s < stop and s + len(ids) > start and start < stop}, (start, stop)


def test_files_have_stripes_indexes_and_filters(spark):
    rows = [(i, f"some words for document {i} " * 40) for i in range(3000)]
    path = orc_tokens.new_folder(spark)
    orc_tokens.write_tokens(rows_of(spark, rows).coalesce(1), path, BYTE, 2, **{"orc.stripe.size": "100000"})
    jvm = spark._jvm
    files = [f for f in spark.read.orc(f"{path}/rows").inputFiles()]
    options = jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration())
    stripes, blooms, runs = 0, 0, set()
    for file in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), options)
        assert reader.getRowIndexStride() == 1000
        names = list(reader.getSchema().getFieldNames())
        column = 1 + names.index("doc_id")
        records = reader.rows()
        for number in range(reader.getStripes().size()):
            stripes += 1
            footer = records.readStripeFooter(reader.getStripes().get(number))
            kinds = [(footer.getStreams(k).getColumn(), footer.getStreams(k).getKind().toString()) for k in range(footer.getStreamsCount())]
            blooms += (column, "BLOOM_FILTER_UTF8") in kinds
            assert (column, "ROW_INDEX") in kinds
            runs.add(footer.getColumns(footer.getColumnsCount() - 1).getKind().toString())
        records.close()
    assert stripes > len(files) and blooms == stripes and runs == {"DIRECT_V2"}


def test_empty_and_null_documents(spark):
    path = orc_tokens.new_folder(spark)
    orc_tokens.write_tokens(rows_of(spark, []), path, BYTE, 2)
    assert checked_rows(spark, path) == [] and orc_tokens.manifest(spark, path).count() == 0
    assert orc_tokens.read_span(spark, path, 0, 10).count() == 0
    path = orc_tokens.new_folder(spark)
    orc_tokens.write_tokens(rows_of(spark, [(None, None), (None, "x"), (3, "")]), path, BYTE, 2)
    end = zlib.crc32(np.array([2], "<u4").tobytes())
    got = checked_rows(spark, path)
    assert {(i, n) for i, _, n, _ in got} == {(-(10**9), 1), (-(10**9), 2), (3, 1)} and got[-1] == (3, 3, 1, end)


def test_a_third_without_id_spreads_over_files(spark):
    docs = spark.range(6000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.lit("the same text").alias("text"))
    path = orc_tokens.new_folder(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        orc_tokens.write_tokens(docs, path, BYTE, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.rows for r in orc_tokens.manifest(spark, path).collect()]
    assert sum(sizes) == 6000 and len(sizes) == 4 and max(sizes) < 2200


# ---- alignment -------------------------------------------------------------------------


def brute_alignment(byte_tokenizer, model, rows):
    byte_tokenizer.encode_special_tokens = True
    back = {c: b for b, c in enumerate(byte_tokens.byte_letters())}
    names = {v: k for k, v in byte_tokenizer.get_vocab().items()}

    def a_bytes(k):
        return bytes(back[c] for c in names[k])

    def b_bytes(k):
        name = model.id_to_piece(k)
        return bytes([int(name[3:5], 16)]) if model.is_byte(k) else name.replace("▁", " ").encode()

    out, counts = [], Counter()
    for doc, text in rows:
        text = text or ""
        whole = (" " + text).encode()
        a, b = byte_tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        if not text or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            out.append((doc, 0, 0, [], ""))
            continue
        ends = []
        for ids, said in ((a, a_bytes), (b, b_bytes)):
            at, own = 0, {}
            for k, i in enumerate(ids):
                at += len(said(i))
                own[at] = k
            ends.append(own)
        groups, links, la, lb = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            ia, ib = ends[0][end], ends[1][end]
            groups.append(",".join(map(str, a[la : ia + 1])) + "|" + ",".join(map(str, b[lb : ib + 1])))
            links.append((a[ia], b[ib]))
            la, lb = ia + 1, ib + 1
        counts.update(links)
        out.append((doc, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    byte_tokenizer.encode_special_tokens = False
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = [(d, na, nb, len(ls), len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), s) for d, na, nb, ls, s in out]
    return rows, counts, best


@pytest.mark.parametrize("limit", [0, 40, 1_000_000])
def test_alignment_by_brute_force(spark, byte_tokenizer, piece_model, data, limit):
    rows = [(k, t) for k, t in enumerate(fuzz(300, 9))] + [(3, "repeated id"), (None, "no id"), (None, "no id"), (2, None), (4, "")]
    rows += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").limit(20).collect()]
    docs, pairs = alignment.align(rows_of(spark, rows).withColumnRenamed("part", "row"), BYTE, PIECE, broadcast_pairs=limit)
    want, counts, best = brute_alignment(byte_tokenizer, piece_model, rows)
    assert Counter(map(tuple, docs.collect())) == Counter(want)
    assert {(r.a_id, r.b_id): (r["count"], r.best) for r in pairs.collect()} == {p: (n, n == best[p[1]]) for p, n in counts.items()}


def test_alignment_of_nothing(spark):
    for rows in ([], [(1, ""), (None, None)]):
        docs, pairs = alignment.align(rows_of(spark, rows), BYTE, PIECE)
        assert pairs.count() == 0 and [tuple(r)[1:] for r in docs.collect()] == [(0, 0, 0, 0, 0, 0, "")] * len(rows)


def test_alignment_without_runs_is_the_same(piece_model):
    texts = [b" " + t.encode() for t in fuzz(200, 4) if t]
    fast, plain = alignment.SpacePieces(PIECE), alignment.SpacePieces(PIECE)
    plain.by_run = False
    texts = [t for t in texts if "▁".encode() not in t]
    assert split(*fast.encode(texts)) == split(*plain.encode(texts))


# ---- collocations ----------------------------------------------------------------------


def brute_phrases(rows, least, top):
    import re

    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                counts[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, all_counts in counts.items():
        known = {p: n for p, n in all_counts.items() if n >= least}
        found = []
        for p, a in known.items():
            if len(p) == 1 or any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in known.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (known[p[:k]] + known[p[k:]]), k, known[p[:k]], known[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, totals[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrase_rows(seed, n=250):
    rng = random.Random(seed)
    words = ["the", "THE", "of", "é", "Éa", "a_b", "x1", " ", "zz", "new", "york", "city"]
    gaps = [" ", "  ", "\t", ". ", ",", "!", "\n", "\r\n", ";", " \x0b "]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choices(gaps, [20, 2, 2, 1, 1, 1, 1, 1, 1, 1])[0] for _ in range(rng.randrange(40)))
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), text + rng.choice(["", "new york city hall ", "new york city ball"])))
    return rows + [("en", None), (None, ""), ("xx", "rare words only")]


def text_frame(spark, rows):
    return spark.createDataFrame([(lang, text, 1, 2, 3) for lang, text in rows], "lang string, text string, rank int, n int, score int")


@pytest.mark.parametrize("seed, least, options", [(1, 5, {}), (2, 12, {"segment_count": 20}), (3, 30, {"max_bits": 1024}), (4, 5, {"segment_count": 1, "max_bits": 1024})])
def test_phrases_by_brute_force(spark, seed, least, options):
    rows = phrase_rows(seed)
    got = collocations.mine(text_frame(spark, rows).repartition(3), least=least, top=50, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, 50)


def test_partial_stripes_may_be_cut_anywhere(spark, monkeypatch):
    rows = phrase_rows(8, 120)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 300)
    monkeypatch.setattr(collocations, "ROW_ENTRIES", 2)
    coded = collocations.coded_texts(text_frame(spark, rows).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text")))
    parts = [(r.lang, collocations._decoded(r.words, r.ids)) for r in coded.collect()]
    hot = (np.empty(0, np.uint64), np.empty(0, np.int64))
    sums = []
    for held in (10, 10**6):
        monkeypatch.setattr(collocations, "HELD", held)
        partial, out = collocations.Partial(1, None, hot), Counter()
        batches = []
        for lang, (words, ids) in parts:
            partial.add(lang, words, ids)
            if partial.full():
                batches += partial.rows()
        batches += partial.rows()
        for b in batches:
            for row in b.to_pylist():
                counts = np.frombuffer(row["counts"], "<i8").tolist()
                assert 0 < len(counts) <= 2
                out.update({(row["lang"], w): n for w, n in zip(row["words"].split(b" "), counts, strict=True)})
        sums.append(out)
    assert sums[0] == sums[1] and sum(sums[0].values()) > 1000


def test_no_phrases(spark):
    for rows in ([], [("en", "one two three")], [(None, None)]):
        assert collocations.mine(text_frame(spark, rows)).collect() == []


def test_phrase_scores_beyond_64_bits(spark):
    """Counts near 2^62: products are exact."""
    big = 1 << 62
    row = spark.range(1).select(F.lit(big).alias("a"), F.lit(big + 3).alias("l"), F.lit(big + 9).alias("r"))
    got = row.select(F.expr("(cast(a AS decimal(30,0)) * 2000000) div (cast(l AS decimal(30,0)) + cast(r AS decimal(30,0)))")).first()[0]
    assert got == 2_000_000 * big // (2 * big + 12)


def test_queries_are_registered():
    names = list(queries.QUERIES)
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert common.MEMO_WORDS > 0
