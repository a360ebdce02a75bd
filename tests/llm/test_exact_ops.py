"""Exact duplicates, Merkle manifests and filter audits against brute force."""

import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from firnlight.llm import audit, exactdup, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Exact duplicates


def groups_by_hand(rows):
    """(id, keep_id, size, kept, digest) of (id, text) rows; null ids last, one row of equal ids kept."""
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    out = []
    for i, (k, _) in enumerate(rows):
        same = [j for j in range(len(rows)) if norm[j] == norm[i]]
        best = min((rows[j][0] is None, rows[j][0] or 0) for j in same)
        out.append((k, None if best[0] else best[1], len(same), (k is None, k or 0) == best, sha(norm[i])))
    return out


def plain(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("digits", [(1, 2, 4), (16, 16, 1 << 20)])
def test_exact_groups_equal_brute_force(spark, digits):
    base = "the ice is as clear as the air over it " * (1 if digits[2] == 4 else 20)
    texts = ["a", "a", "b", "ab", "a b", "a\t\nb", " a b", None, "", "  ", "é", "é", "é", "x y", "x y", base, base, base[:-1] + "!", "!" + base[1:], base + "x",
             base[:30] + "Z" + base[31:], "𝔘nicode", "𝔘nicode"]
    rows = [(100 - i, t) for i, t in enumerate(texts)]
    got = exactdup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), first=digits[0], growth=digits[1], widest=digits[2]).collect()
    assert plain(tuple(r) for r in got) == plain(groups_by_hand(rows))


def test_exact_groups_of_odd_rows(spark):
    """Null and repeated ids: of equal rows one stays; columns with the names of helpers pass through."""
    rows = [(None, "t", 1, "r"), (5, "t", 2, "s"), (5, "t", 3, "u"), (None, None, 4, None), (None, "", 5, "v"), (7, "only", 6, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, rest string")
    got = exactdup.exact_groups(docs, keep=("row", "rest")).collect()
    assert {r["row"]: (r["keep_id"], r["group_size"], r["rest"]) for r in got} == {
        1: (5, 3, "r"), 2: (5, 3, "s"), 3: (5, 3, "u"), 4: (None, 2, None), 5: (None, 2, "v"), 6: (7, 1, "w")}
    kept = {r["row"] for r in got if r["kept"]}
    assert len(kept) == 3 and len(kept & {2, 3}) == 1 and len(kept & {4, 5}) == 1 and 6 in kept
    left = exactdup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.count() == 3


def test_exact_groups_of_an_empty_table_and_of_long_texts(spark):
    assert exactdup.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = "word " * 400_000
    got = exactdup.exact_groups(spark.createDataFrame([(1, long), (2, long[:-1] + "x"), (3, long.replace(" ", "  "))], "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {1: (1, 2), 2: (2, 1), 3: (1, 2)}


def test_exact_groups_take_text_keys(spark):
    got = exactdup.exact_groups(spark.createDataFrame([("b", "t"), ("a", "t"), (None, "t")], "k string, body string"), "k", "body").collect()
    assert {r["k"]: (r["keep_id"], r["kept"]) for r in got} == {"a": ("a", True), "b": ("a", False), None: ("a", False)}


# Merkle manifest


def leaf_by_hand(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels_by_hand(hashes, fanout):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def path_by_hand(levels, i, fanout):
    path = []
    for level in levels[:-1]:
        start = i // fanout * fanout
        path.append(("".join(level[start:i]), "".join(level[i + 1 : start + fanout])))
        i //= fanout
    return path


def manifest_by_hand(rows, fanout):
    """(id, leaf, subroot, root, path) of rows (doc_id, text, lang, source, n_chars)."""
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_by_hand(r[0], r[3], r[2], r[4], r[1])))
    names = sorted(parts, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_by_hand([leaf for *_, leaf in sorted(parts[g])], fanout) for g in names}
    top = levels_by_hand([trees[g][-1][0] for g in names], fanout)
    out = []
    for j, g in enumerate(names):
        for i, (known, k, leaf) in enumerate(sorted(parts[g])):
            out.append((k if known else None, leaf, trees[g][-1][0], top[-1][0], path_by_hand(trees[g], i, fanout) + path_by_hand(top, j, fanout)))
    return out


ODD = [(None, "t", "en", "s", 1), (None, "t", "en", "s", 1), (None, None, None, None, None), (3, "", "", "s", 0), (3, "", "", "s", 0), (-5, "é" * 999, "fr", "s", 2), (2**62, "x", "fr", None, 3),
       (-(2**63), "y", "fr", "q", 4), (2**63 - 1, "z", "fr", "q", 5), (0, "o", "fr", "q", 6)]


@pytest.mark.parametrize("fanout, bucket, n", [(2, 1024, 600), (3, 8, 60)])
def test_manifest_equals_brute_force(spark, fanout, bucket, n):
    """Odd rows, dense ids and a group of one hot id, over buckets that must be split."""
    rows = ODD + [(i * 7, f"text {i % 50}", "en", f"s{i % 3}", i) for i in range(n)] + [(11, "same", "de", "s", 1)] * (n // 3) + [(12, f"d{i}", "de", "s", i) for i in range(n // 3)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("grp", F.lit(1)).withColumn("hash", F.lit("no"))
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    got = merkle.manifest(docs, "doc_id", "lang", fields, fanout, also={"proofs": F.col("n_chars")}, bucket=bucket)
    mine = [(r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(x) for x in r["proof"]]) for r in got.collect()]
    assert plain(mine) == plain(manifest_by_hand(rows, fanout))
    assert got.where(merkle.folded("leaf") != F.col("root")).count() == 0


def test_manifest_of_one_row_none_and_text_keys(spark):
    fields = ["doc_id", "text"]
    one = merkle.manifest(spark.createDataFrame([("k", "t", "g")], "doc_id string, text string, lang string"), "doc_id", "lang", fields).first()
    assert one["leaf"] == one["subroot"] == one["root"] == leaf_by_hand("k", "t") and one["proof"] == []
    assert merkle.manifest(spark.createDataFrame([], DOCS), "doc_id", "lang", fields).count() == 0
    keys = ["b", "a", "ab", "", "a b", "é", None, "zz" * 50]
    rows = spark.createDataFrame([(k, "t", "g") for k in keys], "doc_id string, text string, lang string")
    order = sorted(keys, key=lambda k: (k is not None, (k or "").encode()))
    levels = levels_by_hand([leaf_by_hand(k, "t") for k in order], 2)
    got = {r["doc_id"]: r for r in merkle.manifest(rows, "doc_id", "lang", fields, bucket=2).collect()}
    for i, k in enumerate(order):
        assert [tuple(x) for x in got[k]["proof"]] == path_by_hand(levels, i, 2) and got[k]["root"] == levels[-1][0]


def test_tampered_rows_do_not_verify(spark, tmp_path):
    rows = ODD + [(i, f"text {i}", "en", "s", None if i % 5 == 0 else i) for i in range(60)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    hand = {(k, leaf): (subroot, root, path) for k, leaf, subroot, root, path in manifest_by_hand(rows, 2)}
    assert len(got) == len(rows)
    n_chars = {r[0]: r[4] for r in rows}
    for r in got:
        subroot, root, path = hand[r["doc_id"], r["leaf"]]
        assert (r["subroot"], r["root"], r["proof_sha256"]) == (subroot, root, sha("".join(a + b for a, b in path)))
        k = r["doc_id"]
        assert r["verified"] == (k is None or zlib.crc32(str(k).encode()) % 7 != 0 or n_chars[k] is None) == (r["folded_root"] == root)


# Filter audit


def audit_by_hand(docs, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    flags = []
    for k, text, lang in docs:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        ids = [x[0] for x in docs if (x[1] or "") == t and x[0] is not None]
        copied = bool(ids) and (k is None or min(ids) < k)
        flags.append((lang or "", k, (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), copied)))
    out = []
    for part in {f[0] for f in flags}:
        mine = [f for f in flags if f[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                at = "ABCDE".index(c)
                gone = [f for f in left if f[2][at]]
                left = [f for f in left if not f[2][at]]
                total[c] += len(gone)
                steps.append((part, "".join(order), step, len(left), len(gone), sum(f[2][at] for f in mine) - len(gone), sum(f[2][at] and sum(f[2]) == 1 for f in mine),
                              sum(f[1] in good for f in gone), sum(f[1] in toxic for f in gone)))
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return out


def test_audit_equals_brute_force(spark):
    clean = " ".join(f"w{i}" for i in range(120))
    texts = [clean, clean, clean + " #", "A " * 200, clean.upper(), None, "", "short", "short $", "A" * 30, ("a b " * 100) + "&", clean + " ", "w " * 99 + "w", " ".join(f"v{i}" for i in range(100))]
    docs = [(i, t, [None, "", "en", "fr"][i % 4]) for i, t in enumerate(texts)] + [(None, clean, "en"), (None, "lone", "en"), (None, "lone", "fr"), (2, "again", "fr"), (2, "again", "fr"), (1, clean, "fr"), (0, clean, "en"), (30, clean, "en")]
    labels = [(0, 1, 0), (0, 0, 1), (1, None, None), (2, 1, 1), (4, 0, 0), (30, 1, None), (None, 1, 1), (99, 1, 1)]
    joint = audit.joint_failures(spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("n", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = audit.audit(joint).collect()
    assert plain(tuple(r) for r in got) == plain(audit_by_hand(docs, labels)) and len(got) == 3 * 600


def test_audit_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit.audit(audit.joint_failures(none, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int"))).count() == 0
    some = spark.createDataFrame([(1, "t", "en")], "doc_id long, text string, lang string")
    got = audit.audit(audit.joint_failures(some, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert got.count() == 600 and got.agg(F.sum("good_lost")).first()[0] == 0
