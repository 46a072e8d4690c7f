"""Every registered query of the subpackage on empty, all-null and one-row tables."""

from __future__ import annotations

import pytest

from itemlake.llm import registry

TABLES = {
    "documents": ("doc_id long, text string, lang string, source string, n_chars long", (1, "one two three", "en", "s", 13)),
    "embeddings": ("vec_id long, vec array<float>, label int", (1, [1.0, 0.0], 0)),
    "pages": ("page_id long, url string, html string", (1, "u", "<p>x")),
    "benchmark": ("item_id long, text string", (1, "two")),
    "labels": ("doc_id long, quality int, toxic int", (1, 1, 0)),
    "conversations": ("conv_id long, turn int, role string, text string", (1, 0, "user", "hi")),
}


@pytest.fixture(scope="module", params=["empty", "nulls", "one"])
def odd(request, spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp(request.param)
    for name, (_, row) in TABLES.items():
        like = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
        rows = {"empty": [], "nulls": [(None,) * len(row)], "one": [row]}[request.param]
        spark.createDataFrame(rows, like, verifySchema=False).write.parquet(f"{folder}/{name}.parquet")
    return request.param, str(folder)


@pytest.mark.parametrize("name", sorted(n for n in registry.queries() if n.startswith("op")))
def test_query(spark, odd, name):
    kind, folder = odd
    got = registry.queries()[name](spark, folder).collect()
    per_row = {"op11_filter_audit": 600, "op12_ranked_search": 0 if kind == "nulls" else 1}.get(name, 1)
    extra = 1 if name == "op2_chat_format" else 0  # conversation -1
    assert len(got) == extra + (0 if kind == "empty" else per_row)


def test_very_long_texts(spark, tmp_path):
    import hashlib
    import random

    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "the", "end"])), (3, " ".join(words[70_000:70_060])), (4, "x" * 400_000), (5, "short text")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], TABLES["documents"][0])
    folder = f"{tmp_path}/long"
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], TABLES["labels"][0]).write.parquet(f"{folder}/labels.parquet")
    queries = registry.queries()
    removed = {x.doc_id: (x.n_words, x.n_removed) for x in queries["op3_substring_dedup"](spark, folder).collect()}
    assert removed == {1: (150_000, 0), 2: (150_002, 150_000), 3: (60, 60), 4: (1, 0), 5: (2, 0)}
    counted = {x.doc_id: (x.n_words, x.word_chars, x.base_failed) for x in queries["op5_quality_rules"](spark, folder).collect()}
    assert counted == {i: (len(t.split()), sum(map(len, t.split())), len(t.split()) < 50) for i, t in rows}
    linked = {x.doc_id: (x.class_id, x.n_links) for x in queries["op8_jaccard_join"](spark, folder).collect()}
    assert linked == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 0)}
    said = "<|im_end|>\n" * 60_000
    spark.createDataFrame([(7, 0, "user", said), (7, 1, "assistant", said)], TABLES["conversations"][0]).write.parquet(f"{folder}/conversations.parquet")
    got = {x.conv_id: x for x in queries["op2_chat_format"](spark, folder).collect()}[7]
    assert (got.loss_chars, got.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
