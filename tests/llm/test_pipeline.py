"""The corpus pipeline: every stage against brute force on what the stage before it kept."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tickforge.llm import word_bpe
from tickforge.llm.common import staged
from tickforge.session import scratch_path

from .test_llm import DOCS, empty, groups_brute, measure_brute, odd_texts, vocabulary


@pytest.fixture(scope="module")
def sf_dir(spark):
    """Documents with copies, near copies, wide lines, secrets, odd rows, repeated rows and clashing columns."""
    rng, words = random.Random(9), vocabulary()
    texts = list(odd_texts())
    for i in range(70):
        base = [rng.choice(words) for _ in range(rng.choice([12, 40, 150]))]
        text = " ".join(base)
        if i % 4 == 0:
            text += "\nShared licence line of many sites\nend " + words[i]
        if i % 7 == 0:
            text += f" password = hunter{i}secret99 key AKIA{'ABCDEFGH1234567890'[:16]} {'0123456789abcdef' * 2}"
        texts.append(text)
        for _ in range(rng.randint(0, 2)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    rows = [(i, t, "en", f"s{i % 11}", None if t is None else len(t), 1, "x") for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, " ".join(words[:30]), None, None, 5, 2, None), (None, None, None, None, None, None, None)]
    path = scratch_path(spark, "pipeline")
    spark.createDataFrame(rows, DOCS + ", _rid long, kept string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def stages(spark, docs, sf_dir):
    """(name, rows in, rows out, the frame) of each stage, written between as ``run`` does."""
    for name, f in corpus_pipeline.STAGES:
        out = staged(f(spark, docs, sf_dir), "t-stage")
        yield name, docs.collect(), out.collect(), out
        docs = out


def bag(rows, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in rows)


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen, lib = [], Tokenizer.from_file(word_bpe.default_vocabulary())
    for name, before, after, frame in stages(spark, docs, sf_dir):
        seen.append(name)
        if name != "packing":
            assert frame.columns == docs.columns
        whole = [c for c in docs.columns if c not in ("text", "n_chars")]
        if name == "quality rules":  # what fails the base rules goes; clean documents stay
            assert not bag(after, *docs.columns) - bag(before, *docs.columns)
            measures = [(r, measure_brute(r.text)) for r in before]
            good = [r for r, m in measures if m[0] >= 10 and 100 * m[4] <= 20 * m[0]]
            assert not bag(after, *docs.columns) - bag(good, *docs.columns)
            clean = [r for r, m in measures if r in good and 2 * m[0] <= m[1] <= 15 * m[0] and not m[2] and not m[3]]
            assert clean and not bag(clean, *docs.columns) - bag(after, *docs.columns)
        elif name == "line dedup":
            assert bag(before, *whole) == bag(after, *whole)
            sites = collections.defaultdict(set)
            for r in before:
                for line in (r.text or "").split("\n"):
                    sites[line].add(r.source)
            assert len(sites["Shared licence line of many sites"]) >= 8
            assert not any("Shared licence line" in r.text for r in after if r.text)
            wide = {x for x, v in sites.items() if len(v) >= 8}
            cut = collections.Counter((r.doc_id, "\n".join(x for x in r.text.split("\n") if x not in wide)) for r in before)
            assert bag(after, "doc_id", "text") == cut
        elif name == "MinHash near-dedup":
            _, groups = groups_brute(before, 5)
            first = collections.Counter(min((before[i].doc_id is None, before[i].doc_id or 0) for i in g) for g in groups)
            assert collections.Counter((r.doc_id is None, r.doc_id or 0) for r in after) == first
            assert len(after) < len(before) and not bag(after, *docs.columns) - bag(before, *docs.columns)
        elif name == "secret scan":
            assert bag(before, *whole) == bag(after, *whole)
            assert any("hunter" in r.text for r in before)
            for r in after:
                assert not re.search(r"hunter\d|AKIA[A-Z0-9]{16}|[0-9a-f]{32}", r.text)
            plain = [r for r in before if "password" not in r.text]
            assert plain and not bag(plain, "doc_id", "text") - bag(after, "doc_id", "text")
        else:
            pieces = collections.Counter()
            for r in before:
                ids = lib.encode(r.text or "", add_special_tokens=False).ids + [2]
                for at in range(0, len(ids), 4096):
                    data = ids[at:at + 4096]
                    pieces[r.doc_id, at, len(data), zlib.crc32(np.array(data, "<u4").tobytes())] += 1
            assert bag(after, "doc_id", "start", "length", "ids_crc32") == pieces
            last = bag(after, "doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert seen == ["quality rules", "line dedup", "MinHash near-dedup", "secret scan", "packing"]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert bag(got, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == last
    fill = collections.defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for v in fill.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 4096


def test_empty_tables(spark, sf_dir):
    docs = empty(spark, DOCS + ", _rid long, kept string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_rows_of_nulls_only(spark, sf_dir):
    docs = spark.createDataFrame([(None,) * 5] * 3, DOCS)
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 3 and docs.agg(F.sum("length")).first()[0] == 3  # the end id of each
