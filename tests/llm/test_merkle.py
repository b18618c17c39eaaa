import hashlib
import zlib

import pytest

from spanweave.llm import merkle

from ..compare import duck, rows
from .cases import SCHEMA, awkward, table


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, strip=False):
    doc_id, text, lang, source, n_chars = row[:5]
    text = text.replace("\n", "") if strip and text else text
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(level):
    """The root over a list of digests, and the siblings (before, after) of each."""
    n, paths, at = len(level), [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k in range(n):
            run = at[k] // 3 * 3
            paths[k].append(("".join(level[run : at[k]]), "".join(level[at[k] + 1 : run + 3])))
            at[k] //= 3
        level = [h("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def plain(docs):
    order = lambda v: (v is not None, v if v is not None else 0)
    key = lambda s: (s is not None, (s or "").encode())
    groups = {}
    for row in docs:
        groups.setdefault(row[3], []).append(row)
    roots = {s: climb([leaf_of(r) for r in sorted(g, key=lambda r: (order(r[0]), leaf_of(r)))]) for s, g in groups.items()}
    names = sorted(roots, key=key)
    root, tops = climb([roots[s][0] for s in names])
    out = []
    for s, g in groups.items():
        for k, row in enumerate(sorted(g, key=lambda r: (order(r[0]), leaf_of(r)))):
            path = roots[s][1][k] + tops[names.index(s)]
            even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            node = leaf_of(row, strip=even)
            for before, after in path:
                node = h(before + node + after)
            out.append((row[0], leaf_of(row), roots[s][0], root, h("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def found(spark, docs, tmp_path, monkeypatch):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    return sorted((tuple(r) for r in got), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_equals_brute_force(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    want = plain([r[:5] for r in awkward()])
    assert found(spark, table(spark), tmp_path, monkeypatch) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_one_source_of_every_shape(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    docs = [(i, f"text\n{i}", "en", "s", 7, *[None] * 7) for i in range(n)]
    assert found(spark, spark.createDataFrame(docs, SCHEMA), tmp_path, monkeypatch) == plain(docs)


def test_more_sources_than_rows_in_a_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    docs = [(i, f"a\n{i}", None, None if i % 30 == 0 else ["", "z", "ä", "\U0001f600", "～"][i % 5] + str(i % 30), i, *[None] * 7) for i in range(90)]
    assert found(spark, spark.createDataFrame(docs, SCHEMA), tmp_path, monkeypatch) == plain(docs)


def test_empty_and_null_tables(spark, tmp_path, monkeypatch):
    assert found(spark, spark.createDataFrame([], SCHEMA), tmp_path / "a", monkeypatch) == []
    nulls = [(None,) * 12] * 4
    assert found(spark, spark.createDataFrame(nulls, SCHEMA), tmp_path / "b", monkeypatch) == plain(nulls)


def test_query_equals_its_sql(spark, sf_dir):
    got = merkle.op12_merkle_manifest(spark, sf_dir)
    want = duck(merkle.OP12_SQL, sf_dir)
    assert dict(got.dtypes) == {"doc_id": "bigint", "verified": "boolean", **dict.fromkeys(["leaf", "subroot", "root", "proof_sha256", "folded_root"], "string")}
    assert rows(got.toPandas()) == rows(want)


def test_any_changed_field_is_noticed(spark):
    docs = table(spark).select("doc_id", "text", "lang", "source", "n_chars").dropDuplicates()
    kept = merkle.manifest_of_documents(docs)
    root = kept.first()["root"]
    changed = docs.filter("doc_id = 12").selectExpr("doc_id", "text", "'xx' lang", "source", "n_chars")
    node = changed.select("doc_id", merkle.leaf(*[changed[c] for c in merkle.FIELDS]).alias("new")).join(kept, "doc_id")
    got = node.select(merkle.fold(node["digest"], node["path"]), merkle.fold(node["new"], node["path"])).first()
    assert got[0] == root != got[1]
