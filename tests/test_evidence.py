"""Used, unused, or can't be told: planted sheets and files."""

from tracepath.operators import evidence as e

RULES, CLASSES = "sheet string, rule_id long, line long, selector string, bytes long", "sheet string, rule_id long, name string"
IMPORTERS, READS = "sheet string, file string, bound boolean", "sheet string, file string, name string"


def test_sheets(spark):
    rules = [(s, i, i, f".r{i}", 10 * i) for s in ("sure", "open", "loose", "alone", "mixed") for i in (1, 2, 3, 4)]
    classes = [(s, i, n) for s in ("sure", "open", "loose", "alone", "mixed") for i, names in ((1, "a"), (2, "ab"), (3, "cd")) for n in names]  # rule 4 names none
    importers = [("sure", "x", True), ("sure", "y", True), ("open", "x", True), ("loose", "y", False), ("loose", "x", True), ("mixed", "b", True), ("mixed", "a", False)]
    reads = [("sure", "x", "a"), ("sure", "y", "z"), ("sure", "w", "c"), ("open", "x", None), ("open", "x", "a"), ("loose", "x", "a"), ("alone", "x", "c"), ("mixed", "b", None)]
    t = [spark.createDataFrame(r, s) for r, s in ((rules, RULES), (classes, CLASSES), (importers, IMPORTERS), (reads, READS))]
    judged = {r["sheet"]: (r["file"], r["reason"]) for r in e.sheets_judged(t[0], t[2], t[3]).collect()}
    assert judged == {"sure": (None, None), "open": ("x", e.OPEN), "loose": ("y", e.UNBOUND), "alone": (None, e.NOBODY), "mixed": ("a", e.UNBOUND)}
    # c is read by w only, which doesn't import the sheet
    assert [(r["sheet"], r["rule_id"], r["bytes"]) for r in e.unused_rules(*t).collect()] == [("sure", 3, 30)]
    assert {(r["sheet"], r["classes"]) for r in e.undecidable(*t).collect()} == {("open", 5), ("loose", 5), ("alone", 5), ("mixed", 5)}


def test_imports(spark):
    names = "file_id string, line long, name string"
    imported = spark.createDataFrame([("f", 1, "used"), ("f", 2, "again"), ("f", 3, "never"), ("f", 4, "twice"), ("f", 5, "twice"), ("g", 1, "used")], names)
    mentioned = spark.createDataFrame([("f", 1, "used"), ("f", 9, "used"), ("f", 2, "again"), ("f", 2, "again"), ("f", 4, "twice"), ("f", 5, "twice"), ("g", 1, "used")], names)
    assert {(r["file_id"], r["line"], r["name"]) for r in e.unused_imports(imported, mentioned).collect()} == {("f", 2, "again"), ("f", 3, "never"), ("g", 1, "used")}
    lines = spark.createDataFrame([("f", 9), ("g", 2)], "file_id string, line long")
    assert [tuple(r) for r in e.exported_names(mentioned, lines).collect()] == [("f", "used")]
