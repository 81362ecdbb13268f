"""Hashes of words that a polynomial modulo 2**64 can't tell apart."""

import numpy as np
import pyarrow as pa

from folioscope.llm._kernels import text_bytes, word_bounds, word_hashes
from folioscope.llm.ngram_join import op2_ngram_join
from folioscope.llm.quality_crf import fit_quality
from folioscope.llm.quality_rules import quality_rules
from tests.llm.helpers import documents


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


A, B = thue_morse(4096, "ab"), thue_morse(4096, "ba")


def test_complementary_words_differ():
    for n in (256, 1024, 4096):
        texts = pa.array([f"{thue_morse(n, 'ab')} {thue_morse(n, 'ba')}"])
        data, offsets = text_bytes(texts)
        is_word, starts, ends, _ = word_bounds(data, offsets)
        one, two = word_hashes(data, is_word, starts, ends)
        assert one != two
    assert len(np.unique(word_hashes(*word_args([f"w{i}" for i in range(20_000)])))) == 20_000


def word_args(words):
    data, offsets = text_bytes(pa.array([" ".join(words)]))
    is_word, starts, ends, _ = word_bounds(data, offsets)
    return data, is_word, starts, ends


def test_operators_tell_them_apart(spark, tmp_path):
    docs = documents(spark, [(1, f"{A} two three four five"), (2, f"{B} two three four five"), (3, f"{A}\n{B}\n{A}")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    groups = {r["doc_id"]: r["component_id"] for r in op2_ngram_join(spark, str(tmp_path)).collect()}
    assert groups == {1: 1, 2: 2, 3: 3}
    lines = {r["doc_id"]: r["n_dup_lines"] for r in quality_rules(docs).collect()}
    assert lines[3] == 1


def test_one_row_of_a_repeated_training_id_is_learnt_from(spark, monkeypatch):
    """A third of all rows with one training id: the fit sees one of them, whatever the order."""
    from folioscope.llm import quality_crf

    seen = []
    monkeypatch.setattr(quality_crf.LineField, "fit", classmethod(lambda cls, features, words, row, label, steps=40: seen.append((len(label), len(row)))))
    ids = [i for i in range(40) if i != 5][:20]
    rows = [(1, f"line {i}\nof many") for i in range(3000)] + [(i, f"text {i}\nmore\nlines") for i in ids]
    labels = spark.createDataFrame([(i, i % 2) for i in {1, *ids}], "doc_id long, quality int")
    for n in (1, 4):
        fit_quality(documents(spark, rows).repartition(n), labels, train_lines=100)
    assert seen[0] == seen[1] and seen[0][0] <= 21 and seen[0][1] <= 100
