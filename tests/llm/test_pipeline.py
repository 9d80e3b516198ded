import re
import sys
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from test_ngram_jaccard import brute

import corpus_pipeline as P
from attesta.llm import mixing as M
from attesta.llm.quality_fm import quality
from attesta.llm.secret_ledger import cover_of, spans_of
from attesta.llm.tokenize import default_path

SF = "/root/testdata/sf0.001"


def table(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "ngram_jaccard_join", "secret_scans", "mixing", "packing"]

    good = P.quality_classifier(spark, docs, SF)
    kept = {r.doc_id for r in quality(docs, labels, 5000).collect() if r.score >= 0.5}
    assert good.columns == columns and table(good) == {k: v for k, v in table(docs).items() if k in kept}

    one = P.ngram_jaccard_join(spark, good, SF)
    want = {k: v for k, v in table(good).items() if k in {c for _, c in brute([(k, v["text"]) for k, v in table(good).items()], 5, 80).values()}}
    assert one.columns == columns and table(one) == want

    hidden = P.secret_scans(spark, one, SF)
    for k, v in want.items():
        text = v["text"]
        for a, b in reversed(cover_of(spans_of(text))):
            text = text[:a] + "[secret]" + text[b:]
        v |= {"text": text, "n_chars": len(text)}
    assert hidden.columns == columns and table(hidden) == want

    mixed = P.mixing(spark, hidden, SF)
    taken = {r.doc_id: r.taken for r in M.mix_rows(hidden, P.source_domain(), P.MIX_WEIGHTS, P.MIX_PERCENT, 1).collect()}
    got = table(mixed)
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", v["text"]) for k, v in want.items()}
    assert mixed.columns == columns and set(got) == {k for k in want if k in taken or not words[k]}
    assert all(re.findall(r"[^\x20\x09-\x0D]+", v["text"]) == words[k][: taken.get(k, 0)] and want[k]["text"].startswith(v["text"]) and v["n_chars"] == len(v["text"]) for k, v in got.items())

    packed = P.packing(spark, mixed, SF).collect()
    whole = Tokenizer.from_file(default_path())
    pieces = {}
    for r in packed:
        pieces.setdefault(r.doc_id, []).append(r)
    for k, v in got.items():
        ids = [i for r in sorted(pieces[k], key=lambda r: r.start) for i in np.frombuffer(bytes(r.ids), "<u4").tolist()]
        assert ids == whole.encode(v["text"], add_special_tokens=False).ids + [2]


def test_run(spark):
    out = P.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)


CLASHING = ["_n", "_digest", "_key", "_domain", "_path", "_blob", "row", "doc", "path", "blob", "cover", "key", "n", "taken", "component_id", "label", "score", "part", "ids"]


def test_stages_on_awkward_rows(spark, awkward, tmp_path):
    """Null fields, empty and very long texts, repeated rows, an empty table, and columns named as the stages might name their own."""
    from pyspark.sql import functions as F

    docs = awkward.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce("size", F.lit("-"))).alias(c) for c in CLASHING])
    ids = docs.select("doc_id").distinct().where("doc_id is not null")
    ids.selectExpr("doc_id", "1 as quality", "0 as toxic").write.parquet(f"file://{tmp_path}/labels.parquet")
    for given in (docs, docs.limit(0)):
        rows = sorted(map(str, given.collect()))
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, given, f"file://{tmp_path}")
            got = out.collect()
            assert out.columns == given.columns, name
            if name == "mixing":  # texts are cut and rows go, the other columns are the rows' own
                assert all(r[c] == f"{c} of {r['size'] or '-'}" for r in got for c in CLASHING)
            else:
                assert set(map(str, got)) <= set(rows), name
            if name in ("quality_classifier", "secret_scans"):
                assert sorted(map(str, got)) == rows, name
        pieces = P.packing(spark, given, f"file://{tmp_path}").collect()
        assert len({(r.doc_id, r.doc_tokens) for r in pieces}) <= len(rows) <= len(pieces)
