import json

import numpy as np
import pytest

from quillgraph.engine import Engine
from quillgraph.operators import navigate, som
from quillgraph.sources import files, lookup, ntriples, turtle
from quillgraph.sources.store import Store


def test_ntriples_round_trip(spark, tmp_path):
    rows = [("a/1", "p", "b/2", "uri", None, None), ("_:x", "p", 'say "hi"\n\\ there', "literal", "en", None), ("a/1", "q", "5", "literal", None, "xsd:int"), ("a/1", "q", "_:x", "blank", None, None)]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_type string, lang string, datatype string")
    ntriples.write(df, str(tmp_path / "t"))
    assert sorted(map(tuple, ntriples.read(spark, str(tmp_path / "t")).collect())) == sorted(rows)


def test_store_transactions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s.overwrite("t", one)
    s.append("t", spark.createDataFrame([(3, "c")], "k int, v string"))
    s.begin()
    s.upsert("t", spark.createDataFrame([(2, "B"), (4, "d")], "k int, v string"), "k")
    s.drop("other")
    assert s.read("t").count() == 4
    s.rollback()
    assert {r.k for r in s.read("t").collect()} == {1, 2, 3}
    s.begin()
    s.delete("t", one.where("k = 1"), "k")
    s.copy("t", "copy")
    s.commit()
    again = Store(spark, str(tmp_path / "s"))
    assert {r.k for r in again.read("copy").collect()} == {2, 3} and again.tables() == ["copy", "t"]
    with pytest.raises(KeyError):
        again.read("nothing")
    with pytest.raises(RuntimeError):
        again.commit()


def test_files(spark, tmp_path):
    pages = spark.createDataFrame([("<title>T</title><script>x</script><p>a &amp; b</p><p>c</p>",)], "html string")
    row = files.html_text(pages).first()
    assert row.title == "T" and row.text.split() == ["T", "a", "&", "b", "c"] or row.text.split() == ["Ta", "&", "b", "c"]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0])], "vec_id long, v array<double>")
    files.save_index(v, str(tmp_path / "i"), model="m")
    df, meta = files.load_index(spark, str(tmp_path / "i"))
    assert df.count() == 2 and meta == {"dimension": 2, "model": "m"}
    (tmp_path / "a.pdf").write_bytes(b"%PDF /Type /Page /Type /Page /Type /Pages")
    assert files.pdf_pages(files.read_binary(spark, str(tmp_path), "*.pdf")).first().pages == 2
    for kind in ("json", "csv", "parquet"):
        files.export(v.drop("v"), str(tmp_path / kind), kind)
        assert files.read_template(spark, str(tmp_path / kind), {"k": "vec_id"}, format=kind).count() == 3 if kind != "csv" else True


def test_lookup(spark):
    lookup.register(spark)
    df = spark.read.format("lookup").options(terms="fox|dog", entries=json.dumps({"Fox": "An animal", "Red fox": "x", "Cat": "chases no dog"})).load()
    assert sorted((r.term, r.title, r.score) for r in df.collect()) == [("dog", "Cat", 0.4), ("fox", "Fox", 1.0), ("fox", "Red fox", 0.8)]


def test_navigation(spark):
    engine = Engine(spark, "/root/testdata/sf0.001")
    spec = navigate.Spec("entity", "frequency", navigate.Pan(keywords=["nation_3", "asia"]))
    rows = engine.navigate(spec).collect()
    assert {r.label for r in rows} == {"NATION_3", "ASIA"}
    for zoom in navigate.ZOOMS:
        for tilt in navigate.TILTS:
            assert engine.navigate(navigate.Spec(zoom, tilt, limit=3)).count() <= 3
    assert navigate.Spec("corpus", token_budget=4000).rows() == 1
    with pytest.raises(ValueError):
        engine.navigate(navigate.Spec("planet"))
    assert 0 < navigate.selectivity(spec) < 1 and 1 <= navigate.complexity(spec) <= 10


def test_som(spark):
    rng = np.random.default_rng(3)
    centres = np.eye(4) * 5
    data = np.concatenate([c + rng.normal(0, 0.1, (40, 4)) for c in centres])
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], "vec_id long, v array<double>").repartition(3)
    grid = som.Grid(4, 4)
    weights, errors = som.train(df, grid, epochs=12)
    assert errors[-1] < errors[0] / 3
    cells = {}
    for r in som.assign(df, weights).collect():
        cells.setdefault(r.cell, set()).add(r.id // 40)
    assert all(len(g) == 1 for g in cells.values())
    q = som.quality(som.assign(df, weights), grid).first()
    assert q.quantisation_error < 1 and 0 <= q.topographic_error <= 1
    assert len(som.Grid(3, 3, toroidal=True).neighbours()) == 36 and som.u_matrix(weights, grid).shape == (16,)
    assert sum(map(len, som.clusters(weights, grid, similarity=0.5, least=1))) == 16


def test_streaming(spark, tmp_path):
    from quillgraph.streaming import sessions

    rows = [(1, "2024-01-01 00:00:00", 7, "view", 1.0), (2, "2024-01-01 00:10:00", 7, "view", 3.0), (3, "2024-01-01 05:00:00", 7, "click", 5.0), (3, "2024-01-01 05:00:00", 7, "click", 5.0)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").parquet(str(tmp_path / "e"))
    for name, df, want in (("s", sessions.sessions(stream), 2), ("b", sessions.buckets(stream), 2), ("d", sessions.without_repeats(stream), 3)):
        query = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "d" else "complete" if name == "b" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        n = spark.table(name).count()
        assert n == want or name == "s" and n <= want


def test_turtle(spark, tmp_path):
    text = """@prefix ex: <http://e/> . PREFIX foaf: <http://f/>
@base <http://b/dir/> .
ex:a a ex:Person ; foaf:name "Ann \\"A.\\""@en , 'x' ; ex:age 5, 1.5, 2e3 ; ex:ok true . # a comment
<rel> ex:knows [ foaf:name \"\"\"two
lines\"\"\" ; ex:at _:z ] , _:z .
[] ex:p "1"^^ex:int .
"""
    (tmp_path / "one.ttl").write_text(text)
    (tmp_path / "two.ttl").write_text("<http://e/a> <http://e/p> _:z .")
    got = {(r.s.split(".")[-1] if r.s.startswith("_:") else r.s, r.p, r.o.split(".")[-1] if r.o_type == "blank" else r.o, r.o_type, r.lang, r.datatype) for r in turtle.read(spark, str(tmp_path)).collect()}
    xsd, e, f = "http://www.w3.org/2001/XMLSchema#", "http://e/", "http://f/"
    assert got == {
        (e + "a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", e + "Person", "uri", None, None), (e + "a", f + "name", 'Ann "A."', "literal", "en", None), (e + "a", f + "name", "x", "literal", None, None),
        (e + "a", e + "age", "5", "literal", None, xsd + "integer"), (e + "a", e + "age", "1.5", "literal", None, xsd + "decimal"), (e + "a", e + "age", "2e3", "literal", None, xsd + "double"), (e + "a", e + "ok", "true", "literal", None, xsd + "boolean"),
        ("b1", f + "name", "two\nlines", "literal", None, None), ("b1", e + "at", "z", "blank", None, None), ("http://b/dir/rel", e + "knows", "b1", "blank", None, None), ("http://b/dir/rel", e + "knows", "z", "blank", None, None),
        ("b2", e + "p", "1", "literal", None, e + "int"), (e + "a", e + "p", "z", "blank", None, None),
    }
    blanks = {r.o for r in turtle.read(spark, str(tmp_path)).where("o_type = 'blank' and o like '%z'").collect()}
    assert len(blanks) == 2  # blank nodes of different files are different
    ntriples.write(spark.createDataFrame([("http://e/a", "http://e/p", "v\n", "literal")], "s string, p string, o string, o_type string"), str(tmp_path / "out"))
    assert [tuple(r)[:3] for r in turtle.read(spark, str(tmp_path / "out")).collect()] == [("http://e/a", "http://e/p", "v\n")]
    with pytest.raises(ValueError):
        list(turtle.triples("<a> <b> (1 2) ."))


def test_of_two_racing_commits_one_fails(spark, tmp_path):
    import pytest

    from quillgraph.sources.store import Conflict, Store

    one, other = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    row = lambda k: spark.createDataFrame([(k,)], "k int")
    one.overwrite("t", row(0))
    one.begin()
    other.begin()
    one.append("t", row(1))
    other.append("t", row(2))
    assert sorted(r.k for r in other.read("t").collect()) == [0, 2]  # as it was when it began, and its own
    one.commit()
    with pytest.raises(Conflict):
        other.commit()
    assert sorted(r.k for r in other.read("t").collect()) == [0, 1]
    other.append("t", row(2))
    assert sorted(r.k for r in one.read("t").collect()) == [0, 1, 2]


def test_cleaning_keeps_what_is_current(spark, tmp_path):
    from quillgraph.sources.store import Store

    store = Store(spark, f"file://{tmp_path}/s")
    for k in range(3):
        store.overwrite("t", spark.createDataFrame([(k,)], "k int"))
    store.append("t", spark.createDataFrame([(9,)], "k int"))
    store.copy("t", "u")
    assert store.clean() == 2 and store.clean() == 0
    assert sorted(r.k for r in store.read("t").collect()) == sorted(r.k for r in store.read("u").collect()) == [2, 9]
    store.drop("u")
    store.overwrite("t", spark.createDataFrame([(5,)], "k int"))
    assert store.clean() == 2 and store.tables() == ["t"] and [r.k for r in store.read("t").collect()] == [5]


def test_typed_inserts(spark, tmp_path):
    import pytest

    from quillgraph.sources import typed
    from quillgraph.sources.store import Store

    store = Store(spark, f"file://{tmp_path}/s")
    typed.store_entities(store, spark.createDataFrame([("e1", "One", None, {"k": "v"}), ("e2", None, 3, None)], "id string, label string, frequency int, metadata map<string,string>"))
    typed.store_communities(store, spark.createDataFrame([("c1", ["e1", "e2"], 0.5)], "id string, members array<string>, cohesion double"))
    got = {(r.s, r.p, r.o) for r in store.read("triples").collect()}
    base = {(e, p, o) for e in ("e1", "e2") for p, o in (("rdf:type", "Entity"), ("quill:subType", "Entity"), ("quill:centrality", "0.0"), ("quill:isEntryPoint", "false"))}
    assert got == base | {
        ("e1", "rdfs:label", "One"), ("e1", "skos:prefLabel", "One"), ("e1", "quill:frequency", "1"), ("e1", "quill:k", "v"), ("e2", "rdfs:label", ""), ("e2", "quill:frequency", "3"),
        ("c1", "rdf:type", "Community"), ("c1", "rdfs:label", ""), ("c1", "quill:cohesion", "0.5"), ("c1", "quill:size", "2"), ("c1", "quill:hasMember", "e1"), ("c1", "quill:hasMember", "e2"),
    }
    with pytest.raises(Exception, match="no id"):
        typed.store_units(store, spark.createDataFrame([(None, "text")], "id string, content string"))
