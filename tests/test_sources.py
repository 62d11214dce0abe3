"""Scans, sinks and streaming on small files written here."""

import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagelink.plans.catalog import VIEWS, create_views
from passagelink.sources import files as R
from passagelink.sources import sinks as W
from passagelink.sources import treebank as B
from passagelink.streaming import ingest

HEBREW = """<?xml version="1.0" encoding="UTF-8"?>
<chapter><Sentence verse="ABC 1:1"><Trees>
 <Tree><Node nodeId="cl1" Cat="CL"><Node nodeId="s1" Cat="S"><Node nodeId="np1" Cat="NP" lemma="שם">
   <m xml:id="x1" word="ABC 1:1!1" lang="H" after="">בְּ</m><m xml:id="x2" word="ABC 1:1!1" lang="H" after=" ">שֵׁם</m></Node></Node>
   <Node nodeId="v1" Cat="V"><m xml:id="x3" word="ABC 1:1!2" lang="H"></m><m n="x4" word="ABC 1:1!3" lang="H">דבר</m><m xml:id="x5" word="broken" lang="H">רע</m></Node></Node></Tree>
 <Tree><Node nodeId="other" Cat="CL"><m xml:id="no" word="ABC 1:1!1" lang="H">לא</m></Node></Tree>
</Trees></Sentence><Sentence verse="ABC 1:2"><Trees></Trees></Sentence></chapter>"""
GREEK = """<Sentences><Sentence ref="XYZ 1:1"><Trees><Tree><Node Cat="CL" nodeId="c1"><Node Cat="np" nodeId="n1">
 <Node xml:id="g1" ref="XYZ 1:1!1" Cat="noun" UnicodeLemma="λόγος">λόγος</Node></Node><Node Cat="V" nodeId="v1"><Node xml:id="g2" ref="XYZ 1:1!2" Cat="verb">ἦν</Node></Node></Node></Tree></Trees></Sentence></Sentences>"""
OSIS = """<osis xmlns="http://example.test/osis"><verse osisID="Abc.1.1"><w id="1">דבר</w><w type="x-ketiv" id="2">לא</w><note type="variant"><catchWord>לא</catchWord><rdg type="x-qere"><w id="3">ל/ו</w></rdg></note><w id="4">אור</w></verse>
<verse osisID="Abc.1.2"><w type="x-ketiv" id="5">נא</w><note type="variant"><rdg type="x-qere"/></note><w type="x-ketiv" id="6">כל</w><w id="7">יום</w><note type="variant"><rdg type="x-qere"><w id="8">היא</w></rdg></note></verse>
<verse osisID="Abc.1.3"><w id="9">שם</w><note type="variant"/></verse></osis>"""


@pytest.fixture
def xml(tmp_path):
    for n, t in (("h.xml", HEBREW), ("bad.xml", "<a><b></a>")):
        (tmp_path / "heb" / n).parent.mkdir(exist_ok=True)
        (tmp_path / "heb" / n).write_text(t, encoding="utf-8")
    for d, t in (("grk", GREEK), ("osis", OSIS)):
        (tmp_path / d).mkdir()
        (tmp_path / d / "f.xml").write_text(t, encoding="utf-8")
    return tmp_path


def test_hebrew_treebank(spark, xml):
    scan = B.treebank(spark, str(xml / "heb"), "hebrew").cache()
    t = {r.source_record_id: r for r in B.records(scan).collect()}
    assert set(t) == {"x1", "x2", "x3", "x4"}
    assert (t["x2"].word, t["x2"].sub, t["x2"].clause_id, t["x2"].phrase_id, t["x2"].role, t["x2"].alternate_trees) == (1, 2, "h.xml#cl1", "h.xml#np1", "S", 1)
    assert '"lemma":"שם"' in t["x1"].attributes and t["x3"].role == "V" and t["x1"].seq == 1
    assert sorted(r.code for r in B.issues(scan).collect()) == ["alternate-syntax-trees", "malformed-token", "sentence-without-tree", "source-id-fallback", "unparsable", "zero-width-morpheme"]


def test_greek_treebank(spark, xml):
    t = B.records(B.treebank(spark, str(xml / "grk"), "greek")).orderBy("seq").collect()
    assert [(r.surface, r.book, r.chapter, r.word, r.role) for r in t] == [("λόγος", "XYZ", 1, 1, None), ("ἦν", "XYZ", 1, 2, "V")]
    assert t[0].phrase_id == "f.xml#n1" and t[0].clause_id == "f.xml#c1"


def test_ketiv_qere(spark, xml):
    scan = B.ketiv_qere(spark, str(xml / "osis"))
    loci = B.records(scan, "locus")
    got = [(r.chapter, r.verse, r.kind, [w.slot for w in r.ketiv], [w.text for w in r.qere], r.slots) for r in loci.orderBy("verse", "ordinal").collect()]
    assert got == [(1, 1, "paired", [2], ["לו"], 4), (1, 2, "ketiv_only", [1], [], 4), (1, 2, "ketiv_only", [2], [], 4), (1, 2, "qere_only", [], ["היא"], 4)]
    assert [r.code for r in B.issues(scan).collect()] == ["empty-variant"]
    primary = spark.createDataFrame([("Abc", 1, 1, 3, 1, "ל֖", "t1"), ("Abc", 1, 1, 3, 2, "וֹ", "t2"), ("Abc", 1, 2, 4, 1, "הוא", "t3")], "book string, chapter int, verse int, word int, sub int, surface string, token_id string")
    r = {(x.verse, x.ordinal): x for x in B.locus_registry(loci, primary).collect()}
    assert r[1, 1].match_tier == "consonantal" and r[1, 1].primary_ids == ["t1", "t2"] and r[2, 3].match_tier == "conflict" and r[2, 1].match_tier is None
    assert B.supplementary_tokens(loci).count() == 3


def test_cross_references(spark, tmp_path):
    p = tmp_path / "x.txt"
    p.write_bytes("From\tTo\tVotes\t#note\nGen.1.1\tJohn.1.1\t7\nGen.1.1\tJohn.1.1\t7\n\nGen.1.1\tJohn.1.1\nGen.1.1\t\t3\nGen.1.1\tJohn 1:1\t3\nGen.1.1\tJohn.1.1\tx\r\nGen.1.1\tJohn.1.1-2.3\t-4\n".encode() + b"Gen.1.1\t\xff\t3\n")
    r = R.cross_references(spark, str(p)).orderBy("line_number").collect()
    assert [x.parse_status for x in r] == ["parsed", "parsed", "invalid_blank_record", "invalid_column_count", "invalid_empty_reference", "invalid_reference_syntax", "invalid_weight", "parsed", "invalid_encoding"]
    assert (r[0].votes, r[1].duplicate_ordinal, r[7].votes) == (7, 2, -4)
    from passagelink.operators.benchmark import source_audit

    a = source_audit(R.cross_references(spark, str(p))).collect()[0]
    assert (a.n_rows, a.n_parsed, a.duplicates, a.reverse_pairs) == (9, 3, 1, 0)


def test_csv_and_jsonl(spark, tmp_path):
    s = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.IntegerType())])
    (tmp_path / "ok.csv").write_text("a,n\nx,1\n")
    (tmp_path / "bad.csv").write_text("a,m\nx,1\n")
    assert R.strict_csv(spark, str(tmp_path / "ok.csv"), s, 1).count() == 1
    with pytest.raises(ValueError):
        R.strict_csv(spark, str(tmp_path / "ok.csv"), s, 0)
    with pytest.raises(Exception):
        R.strict_csv(spark, str(tmp_path / "bad.csv"), s).collect()
    df = spark.createDataFrame([("b", 2), ("a", 1), ("c", None)], s)
    W.write_jsonl(df, str(tmp_path / "j"), ["a"])
    rows, odd = R.canonical_jsonl(spark, str(tmp_path / "j"), s)
    assert rows.orderBy("a").collect() == df.orderBy("a").collect() and odd.isEmpty()
    (tmp_path / "k.jsonl").write_text('{"n":1,"a":"x"}\n{"a":"x","n":1}\n')
    assert R.canonical_jsonl(spark, str(tmp_path / "k.jsonl"), s)[1].count() == 1
    assert R.typed_jsonl(spark, str(tmp_path / "k.jsonl"), s).count() == 2


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(i, f"g{i % 3}") for i in range(30)], "i int, g string")
    t = str(tmp_path / "t")
    info = W.write_artifact(df, t, partition_by=["g"])
    assert info["rows"] == 30 and R.artifact(spark, t, order=["i"]).count() == 30
    with pytest.raises(FileExistsError):
        W.write_artifact(df, t)
    again = W.write_artifact(df.repartition(5), t, partition_by=["g"], force=True)
    assert again["logical_hash"] == info["logical_hash"]
    (tmp_path / "t.staging-x").mkdir()
    assert W.recover(spark, t) == ["removed t.staging-x"]
    assert set(W.stage_tables({"a": df, "b": df.limit(1)}, str(tmp_path / "s"))) == {"a", "b"}
    p = df.select(F.col("i").alias("pid"), F.col("g").alias("feature"), F.lit(1).alias("tf"))
    W.write_postings(p, str(tmp_path / "p"), "lemma")
    assert W.load_postings(spark, str(tmp_path / "p"), "lemma").count() == 30
    assert [r.i for r in W.merge_sorted([df.filter("i < 5"), df.filter("i >= 5")], ["i"]).collect()] == list(range(30))
    assert W.register_catalog({"v_t": df}, {"v_t": ["i"]}) == ["v_t"]
    with pytest.raises(ValueError):
        W.register_catalog({"v_t": df}, {"v_t": ["g"]})
    W.write_review_bundle(df.select(F.col("i").alias("candidate"), F.array("g").alias("gs")), df.select(F.col("i").alias("candidate"), W.dossier("x", ["g"]).alias("markdown")), str(tmp_path / "bundle"))
    assert spark.read.parquet(str(tmp_path / "bundle/candidates.parquet")).count() == 30


def test_stage_store(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        s = W.StageStore(spark, str(tmp_path / "stages"))
        assert s.run("a", build, {"x": 1}).count() == 3
        s.run("b", lambda: spark.range(1), needs=("a",))
    assert len(calls) == 1
    W.StageStore(spark, str(tmp_path / "stages")).run("a", build, {"x": 2})
    assert len(calls) == 2


def test_archives(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("hello")
    h = hashlib.sha256(b"hello").hexdigest()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a.txt", "hello")
    assert R.zip_inventory(str(tmp_path / "z.zip"), {"a.txt": h}) == []
    assert R.zip_inventory(str(tmp_path / "z.zip"), {"a.txt": "0", "b.txt": h}) == [("a.txt", "contents differ"), ("b.txt", "missing")]
    assert R.unpack(str(tmp_path / "z.zip"), {"a.txt": h}, str(tmp_path / "o")) == ["a.txt"]
    with zipfile.ZipFile(tmp_path / "evil.zip", "w") as z:
        z.writestr("../a.txt", "hello")
    with pytest.raises(ValueError, match="unsafe"):
        R.unpack(str(tmp_path / "evil.zip"), {"../a.txt": h}, str(tmp_path / "o"))
    assert [r.sha256 for r in R.inventory(spark, str(tmp_path / "d")).collect()] == [h]
    W.package(str(tmp_path / "d"), str(tmp_path / "1.tar")), W.package(str(tmp_path / "d"), str(tmp_path / "2.tar"))
    assert R.file_hash(str(tmp_path / "1.tar")) == R.file_hash(str(tmp_path / "2.tar"))
    assert W.publish(spark, str(tmp_path / "d"), f"file://{tmp_path}/copy")


def test_sequences_fail_closed(spark):
    p = spark.createDataFrame([("p", "h"), ("q", "g")], "passage_id string, corpus string")
    m = spark.createDataFrame([("p", "t1", 1), ("p", "t2", 2)], "passage_id string, token_id string, position_in_passage bigint")
    t = spark.createDataFrame([("t1", "x"), ("t2", None)], "token_id string, lemma string")
    r = R.passage_sequences(p, m, t, {"corpus": "h"}).collect()
    assert [(e.position, e.lemma) for e in r[0].elements] == [(1, "x"), (2, None)]
    with pytest.raises(Exception, match="unresolved"):
        R.passage_sequences(p, m, t.limit(1), {"corpus": "h"}).collect()
    pairs, audit = R.pair_projection(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 2), ("a", 1), ("c", 1)], "k string, e int"), "k")
    assert [[x.e for x in r.evidence] for r in pairs.collect()] == [[1, 2]] and audit.count() == 2
    assert R.hydrate(spark.createDataFrame([("a", 1), ("z", 1)], "k string, e int"), pairs, "k").count() == 1


def test_views_register(spark, data):
    names = create_views(spark, data, "v_")
    assert len(names) == len(VIEWS) and spark.sql("SELECT count(*) AS n FROM v_verse_passages").collect()[0].n > 0


def test_streaming_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a", "2024-01-01 00:00:00"), (2, None, None), (3, "c", "2024-01-01 05:00:00")], "doc_id bigint, text string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: ingest.index_documents(ingest.document_stream(spark, str(tmp_path / "in"), docs.schema), "doc_id", "text", str(tmp_path / "idx"), str(tmp_path / "cp")).awaitTermination()
    run()
    docs.filter("doc_id = 1").unionByName(docs.filter("doc_id = 3").withColumn("doc_id", F.lit(4).cast("bigint"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {(r.pid, r.feature): r.tf for r in spark.read.parquet(str(tmp_path / "idx")).collect()}
    assert got == {(1, "a"): 2, (1, "b"): 1, (3, "c"): 1, (4, "c"): 1}
    late = ingest.arrivals(ingest.document_stream(spark, str(tmp_path / "in"), docs.schema).withColumn("received_at", F.col("created_at") + F.expr("INTERVAL 2 HOURS")), "created_at", "received_at")
    q = late.writeStream.outputMode("complete").format("memory").queryName("late_docs").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n_late) AS n FROM late_docs").collect()[0].n == 4
