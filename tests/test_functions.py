import uuid

from pyspark.sql import functions as F

from weftline.functions import ids, text, vector


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_trigram_values(spark):
    for a, b, want in [("agent", "Agent", 1.0), ("ns.Agent", "Agent", 0.667), ("resource_id", "Resource", 0.75), ("ns.Resources", "Resource", 0.571), ("resource_timestamp", "Resource", 0.474)]:
        assert abs(one(spark, text.similarity(F.lit(a), F.lit(b))) - want) < 1e-3
    assert one(spark, text.similarity(F.lit(""), F.lit("..."))) == 0.0


def test_uuids(spark):
    for name in ("a", "user.é", ""):
        assert one(spark, ids.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
        assert one(spark, ids.uuid3(F.lit(name))) == str(uuid.uuid3(uuid.NAMESPACE_DNS, name))
    f = {"uri": (F.lit("u"), "string"), "ordinal": (F.lit(1), "number")}
    assert one(spark, ids.jsonb_uuid(f)) != one(spark, ids.sorted_json_uuid(f))


def test_vectors(spark):
    v = vector.literal_vector
    assert one(spark, vector.l2(v([0, 3]), v([4, 0]))) == 5.0
    assert one(spark, vector.l2(v([0, 3]), v([4]))) is None
    assert one(spark, vector.cosine_distance(v([1, 0]), v([0, 0]))) is None


def test_word_chunks_lose_nothing():
    for t in ("".join(f"{i:06d}" for i in range(1000)), " ".join(f"w{i}" for i in range(3000)), "\n".join(f"a b{i}" for i in range(900)), "", "short"):
        chunks = text.word_chunks(t)
        assert all(len(c) <= 1000 for c in chunks)
        at = 0
        for c in chunks:
            i = t.index(c, max(0, at - 400))
            assert t[at:i].strip() == "" if i > at else True
            at = max(at, i + len(c))
        assert t[at:].strip() == ""


def test_markdown_sections():
    s = text.markdown_sections("intro\n\n# A\np1\n\np2\n## B\nq\n# C\nr\n##### deep\n")
    assert [(x[0], x[1], x[3]) for x in s] == [(0, 0, []), (1, 0, ["A"]), (2, 1, ["A"]), (3, 0, ["A", "B"]), (4, 0, ["C"])]


def test_upload_metadata_and_url(spark):
    m = one(spark, text.upload_metadata(F.lit("filename YS50eHQ=, empty")))
    assert m == {"filename": "a.txt", "empty": ""}
    q = text.encode_url_query(F.create_map(F.lit("status"), F.array(F.lit("sold"), F.lit("available")), F.lit("a"), F.array(F.lit("1"))))
    assert one(spark, q) == "a=1&status=sold,available"
