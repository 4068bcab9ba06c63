"""A store of relations that follows changes, against the relations of the units as they are."""

from quern.operators import declarations
from quern.plans.program import Program
from quern.streaming.files import stream_units
from quern.streaming.incremental import RELATIONS, Store


def _rows(df):
    return sorted(repr(sorted(r.asDict(True).items())) for r in df.collect())


def _units(spark, rows):
    return spark.createDataFrame(rows, "unit_id string, src string")


def test_batches_and_repeats(spark, tmp_path):
    lexed = []
    symbols = lambda p: lexed.append(sorted(r["unit_id"] for r in p.units.collect())) or declarations.symbols(p.kept)
    store = Store(spark, f"file://{tmp_path}/store", {"symbols": symbols})
    assert store.ledger() is None
    store.apply(_units(spark, [("a", "int x;"), ("b", "int y;"), ("c", ""), ("b", "int older;")]), 0)
    store.apply(_units(spark, [("a", "int x;"), ("b", "int y2, z;"), ("d", "int w;"), ("c", None)]), 1)
    for _ in range(2):
        store.apply(_units(spark, [("d", "int w;"), ("a", "int a2;")]), 2)
        store.apply(_units(spark, []), 3)
    assert lexed == [["a", "b", "c"], ["b", "d"], ["a"], [], ["a"], []]
    now = [("a", "int a2;"), ("b", "int y2, z;"), ("d", "int w;")]
    assert _rows(store.relation("symbols")) == _rows(declarations.symbols(Program(_units(spark, now)).kept))
    assert {r["unit_id"]: r["batch"] for r in store.ledger().where("digest IS NOT NULL").collect()} == {"a": 2, "b": 1, "d": 1}
    less = store.compacted(f"file://{tmp_path}/less")
    assert _rows(less.relation("symbols")) == _rows(store.relation("symbols")) and {r["batch"] for r in less.ledger().collect()} == {0}


def test_a_folder_is_followed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write = lambda name, text: (tmp_path / "in" / name).write_text(text)
    store = Store(spark, f"file://{tmp_path}/store", order="arrived")
    for k, files in enumerate(({"a.c": "int a; void f(void) { g(1); }", "b.c": "typedef int T;"}, {"c.c": "T x; void h(void) { f(); }"})):
        for name, text in files.items():
            write(name, text)
        stream = stream_units(spark, f"file://{tmp_path}/in")
        store.follow(stream, f"file://{tmp_path}/checkpoint").awaitTermination(120)
        assert store.ledger().where(f"batch = {k}").count() == len(files)
    units = spark.read.format("text").option("wholetext", "true").load(f"file://{tmp_path}/in").selectExpr("_metadata.file_path AS unit_id", "value AS src")
    program = Program(units)
    for name, relation in RELATIONS.items():
        assert _rows(store.relation(name)) == _rows(relation(program)), name
