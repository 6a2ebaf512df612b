import glob
import os

import pyspark
import pytest

from weftgraph.operators import dispatch as V
from weftgraph.sources import files, sinks
from weftgraph.streaming import incremental

JAR = sorted(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "javax.inject*.jar")) or glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "*inject*.jar")))[0]


def test_class_files_of_a_jar(spark, tmp_path):
    g = files.class_graph(files.classes(spark, [JAR]))
    kinds = {r.kind: r["count"] for r in g.nodes.groupBy("kind").count().collect()}
    assert kinds["ANNOTATION_CLASS"] + kinds.get("INTERFACE", 0) >= 5
    assert g.nodes.filter("id = 'class:jakarta/inject/Inject'").count() == 1
    assert g.edges.filter("kind = 'MEMBER'").count() == g.nodes.filter("id LIKE 'method:%' OR id LIKE 'field:%'").count()
    assert V.overrides(g).count() >= 0
    files.save(g, str(tmp_path / "g"))
    again = files.load(spark, str(tmp_path / "g"), ("enclosures",))
    assert sinks.revision(again).collect() == sinks.revision(g).collect()


def test_export_reads_back(spark, tmp_path):
    g = files.class_graph(files.classes(spark, [JAR]))
    sinks.write_text(sinks.ndjson(g), str(tmp_path / "out"))
    again = files.load_ndjson(spark, str(tmp_path / "out"))
    assert again.nodes.count() == g.nodes.count()
    assert again.edges.count() == g.edges.select("source", "target", "kind").distinct().count()


def test_stream_adds_each_class_once(spark, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(JAR, tmp_path / "in" / "a.jar")
    for k in range(2):
        incremental.keep(incremental.arrivals(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
        shutil.copy(JAR, tmp_path / "in" / f"b{k}.jar")
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert rows.count() == rows.select("name").distinct().count() == files.classes(spark, [JAR]).count()
    assert incremental.graph(spark, str(tmp_path / "t")).nodes.count() > 5


def test_manifest_and_layouts(spark, tmp_path):
    ns = 'xmlns:android="http://schemas.android.com/apk/res/android"'
    (tmp_path / "M.xml").write_text(f'<manifest {ns}>\n<application android:name=".App">\n<activity android:name="Main"/>\n<activity-alias android:targetActivity="x.y.Real"/>\n<meta-data android:name="k" android:value="a:com.z.Init"/>\n</application></manifest>')
    found = {(r.node_id, r.line) for r in files.manifest(spark, [str(tmp_path / "M.xml")], "com.a").collect()}
    assert found == {("class:com/a/App", 2), ("class:com/a/Main", 3), ("class:x/y/Real", 4), ("class:com/z/Init", 5)}
    (tmp_path / "bad.xml").write_text(f'<manifest {ns}><activity android:name="${{x}}.A"/></manifest>')
    with pytest.raises(Exception, match="not resolved"):
        files.manifest(spark, [str(tmp_path / "bad.xml")], "a").collect()
    (tmp_path / "res").mkdir()
    (tmp_path / "res" / "l.xml").write_text(f'<layout {ns}><data><variable type="java.util.List&lt;com.q.Item&gt;"/></data><com.q.View class="n"/><include layout="@layout/other"/><include layout="@{{x}}"/></layout>')
    assert {r.node_id for r in files.layout_classes(spark, [str(tmp_path / "res")]).collect()} == {"class:java/util/List", "class:com/q/Item", "class:com/q/View"}
    assert {(r.layout, r.included) for r in files.layout_includes(spark, [str(tmp_path / "res")]).collect()} == {("l", "other"), ("l", None)}


def test_small_files(spark, tmp_path):
    d = tmp_path / "META-INF" / "services"
    d.mkdir(parents=True)
    (d / "a.b.Svc").write_text("# note\n x.Y # more\n\nz.W$In\n")
    assert {(r.service, r.provider, r.line) for r in files.services(spark, [str(tmp_path)]).collect()} == {("a.b.Svc", "x.Y", 2), ("a.b.Svc", "z.W$In", 4)}
    (tmp_path / "d.tsv").write_text("# c\ng:a:1\tapi\ta.jar\n")
    assert [tuple(r) for r in files.dependency_list(spark, [str(tmp_path / "d.tsv")]).collect()] == [("g:a:1", "api", "a.jar")]
    (tmp_path / "seen.txt").write_text("# x\na.b.C\nd/E.class\n")
    (tmp_path / "cov.xml").write_text('<report><class name="p/Q"><counter covered="2"/></class><class name="p/R"><counter covered="0"/></class></report>')
    assert {r.id for r in files.runtime_classes(spark, [str(tmp_path / "seen.txt")], [str(tmp_path / "cov.xml")]).collect()} == {"class:a/b/C", "class:d/E", "class:p/Q"}
    a = files.fingerprints(spark, [str(tmp_path / "d.tsv")], "deps")
    (tmp_path / "d2.tsv").write_text("x")
    b = files.fingerprints(spark, [str(tmp_path / "d.tsv"), str(tmp_path / "d2.tsv")], "deps")
    assert sorted(r.status for r in files.freshness(a, b).collect()) == ["added", "same"]
