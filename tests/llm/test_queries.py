"""The registered queries and the pipeline on the smallest tables, against brute force where SQL has no say."""

import base64
import hashlib
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
import public_tokenizers
from harrow.llm import quality, queries, scratch, sharding

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def result(spark, name):
    return queries.queries()[name](spark, SF).toPandas()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF).select(columns).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want.fetchall()))


def test_op2(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = result(spark, "op2_packing").sort_values(["doc_id", "start"])
    for doc, g in got.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 2], dtype="<u4")
        assert (g["start"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() == len(ids) == g["doc_tokens"].iloc[0]
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in g.itertuples())
    assert set(got["doc_id"]) == set(texts)


def test_op3(spark, texts):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in result(spark, "op3_sentencepiece").itertuples():
        ids = sp.encode(texts[r.doc_id])
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_op4_revisits(spark, tmp_path):
    """Equal payloads, empty and null ones included: the largest page responds."""
    html = {1: "a", 2: "b", 3: "a", 4: None, 5: "", 6: "c" * 100_000, 7: "a"}
    spark.createDataFrame(list(html.items()), "page_id long, html string").selectExpr("page_id", "'http://x/' || page_id AS url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in queries.op4_warc(spark, str(tmp_path)).collect()}
    for i, text in html.items():
        data = (text or "").encode()
        first = max(j for j in html if (html[j] or "") == (text or ""))
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == first else "revisit", None if i == first else first)
        assert tuple(got[i][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want


def test_op6(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text").collect()]
    by_source, placed, n = {}, [], len(rows)
    digest = lambda x: hashlib.md5(f"42:{x}".encode()).hexdigest()
    for doc, source, _ in rows:
        by_source.setdefault("-" if source is None else f"s{source}", []).append(doc)
    for source, docs in by_source.items():
        shift = int(digest(source)[:13], 16) / 2**52
        placed += [((k + shift) / len(docs), source, k, doc) for k, doc in enumerate(sorted(docs, key=lambda d: (digest(d), d)))]
    at = {doc: k for k, (*_, doc) in enumerate(sorted(placed))}
    text = {doc: (t or "").encode() for doc, _, t in rows}
    for r in queries.op6_sharding(spark, "/root/testdata/sf0.01").collect():
        shard, own = at[r["doc_id"]] * 24 // n, text[r["doc_id"]]
        assert (r["shard"], r["slot"], r["law"], r["grown_shard"]) == (shard, at[r["doc_id"]] - -(-shard * n // 24), "rows", None)
        assert (r["size"], r["text_crc32"]) == (len(own) + 8, zlib.crc32(own))


def test_op6_spreads_small_sources(spark):
    rows = [(i, "one" if i < 1200 else f"s{i}", "x") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sharding.shard_documents(docs, 24).toPandas()
    small = got[got["source"] != "one"].groupby("shard").size()
    assert len(small) == 24 and small.min() >= 30 and small.max() <= 70 and set(got.groupby("shard").size()) == {100}


def test_op8(spark, texts):
    """Fingerprints by the contract's words, links between all pairs."""
    import re

    import xxhash

    fp = {}
    for doc, text in texts.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
        grams = [b" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        fp[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    group = {d: d for d in fp}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 3 and root(a) != root(b):
                group[max(root(a), root(b))] = min(root(a), root(b))
    for r in result(spark, "op8_simhash").itertuples():
        assert (r.fingerprint, r.component_id) == (f"{fp[r.doc_id]:016x}", root(r.doc_id))


def test_op9(spark, texts):
    words, first = {i: t.encode().split() for i, t in texts.items()}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for r in result(spark, "op9_substring").itertuples():
        w = words[r.doc_id]
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < r.doc_id for j in range(k, k + 13)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())


def test_op10_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = queries.queries()["op10_quality"](spark, "/root/testdata/sf0.01").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    held = got[got["held_out"] & got["doc_id"].isin(list(labels))]
    assert (held["predicted"] == held["doc_id"].map(labels)).mean() > 0.85


def test_pipeline_stages(spark):
    """Each stage's decisions by brute force over its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    def rows(df):
        return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}

    def step(name, df):
        out = scratch.materialize(stages[name](spark, df, SF), "test")
        assert out.columns == columns
        return out

    kept = step("quality", docs)
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").where(~quality.held_out(quality.F.col("doc_id"))))
    good = {i for i, t in rows(docs).items() if model.score([t.encode()])[0] >= 0.3}
    assert set(rows(kept)) == good
    one = step("exact", kept)
    before = rows(kept)
    assert set(rows(one)) == {max(j for j in before if before[j] == t) for t in set(before.values())}
    near = step("near", one)
    texts, group = rows(one), {}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in texts.items() for w in [t.encode().lower().split()]}
    similar = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in texts for b in texts if a < b and grams[a] and grams[b]}
    left = rows(near)
    for (a, b), j in similar.items():
        if j >= 0.85:
            assert not (a in left and b in left), (a, b, j)
    lost = set(texts) - set(left)
    assert all(any(similar.get((a, b), 0) >= 0.5 for a in texts) for b in lost)
    cut = step("substring", near)
    words, first = {i: t.encode().split() for i, t in left.items()}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for i, text in rows(cut).items():
        gone = {j for k in range(len(words[i]) - 12) if first[tuple(words[i][k : k + 13])] < i for j in range(k, k + 13)}
        assert text == (left[i] if not gone else b" ".join(w for j, w in enumerate(words[i]) if j not in gone).decode())
    packed = stages["packing"](spark, cut, SF).toPandas()
    assert set(packed["doc_id"]) == set(left) and (packed.groupby("doc_id")["length"].sum() == packed.groupby("doc_id")["doc_tokens"].first()).all()
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 4096


def test_licences_over_several_lines(spark):
    """Headers and whole texts wrapped over comment lines within longer documents; nothing in ordinary prose."""
    import textwrap

    from harrow.llm import licenses

    code = "\n".join(f"    value_{i} = compute(value_{i - 1}, {i})" for i in range(80))
    wrap = lambda name, mark: "\n".join(mark + x for x in textwrap.wrap(licenses.TEMPLATES[name], 72))
    names = ["Apache-2.0-header-whole", "MIT-text", "MIT-grant", "BSD-2-Clause-text", "ISC-text", "GPL-3.0-header", "MPL-2.0"]
    rows = [(k, f"# Copyright 2020\n#\n{wrap(n, '# ')}\n#\n{code}") for k, n in enumerate(names)]
    rows += [(20, code), (21, "the software is a thing that people use, and copy"), (22, f"{code}\n{licenses.TEMPLATES['MIT']}\n{code}")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, n in enumerate(names):
        assert (got[k]["license"], got[k]["line"], got[k]["n_lines"]) == (n, 2, len(wrap(n, "# ").split("\n"))) and got[k]["score"] == 1.0
    assert got[20]["license"] is None and got[21]["n_matched"] == 0
    assert (got[22]["license"], got[22]["line"], got[22]["n_lines"], got[22]["n_matched"]) == ("MIT", 80, 1, 1)
