"""Files as they are: content hashes, CSV with line breaks in cells, import of files."""

import csv
import gzip
import hashlib
import random
import re

import pytest
from fixtures import ROWS, input_sheets

from tidemark.model import SHEETS
from tidemark.plans import importing, rules
from tidemark.sources import landing


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fingerprints_of_any_content(spark, tmp_path, small_splits):
    mark = b"\xef\xbb\xbf"
    rng = random.Random(1)
    contents = {
        "plain.csv": b"a,b\n1,2", "ended.csv": b"a,b\n1,2\n", "dos.csv": b"a\r\nb\r\n", "marked.csv": mark + b"a\nb",
        "marked ended.csv": mark + b"a\n", "only mark": mark, "two marks": mark + mark + b"\n", "line": b"\n", "lines": b"\n\n\n",
        "empty": b"", "one": b"x", "a+b%20c.csv": b"sign", "binary.xlsx": rng.randbytes(300_000), "no line break": bytes([7]) * 50_000,
        "long.csv": b"".join(b"row %d\n" % i for i in range(20_000)), "packed.csv.gz": gzip.compress(b"a\n" * 99)}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    got = landing.fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(contents)
    assert sorted((r.file_size_bytes, r.file_sha256) for r in got) == sorted(
        (len(c), hashlib.sha256(c).hexdigest()) for c in contents.values())
    by_name = {r.path.rsplit("/", 1)[1]: r.file_sha256 for r in got}
    assert by_name["binary.xlsx"] == hashlib.sha256(contents["binary.xlsx"]).hexdigest()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_line_breaks_in_cells_in_many_splits(spark, tmp_path, small_splits, end):
    rng = random.Random(len(end))
    pool = ["", "x", "two\nlines", 'a "quoted" word', "comma, and\n\nblank", '"', "\n", "é😀", "tail "]
    expected = []
    for name in ("a.csv", "b.csv"):
        rows = [[rng.choice(pool) + str(i), rng.choice(pool), rng.choice(pool) + "."] for i in range(400)]
        with open(tmp_path / name, "w", encoding="utf-8", newline="") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerow(["first", "second col", "third"])
            out.writerows(rows)
        expected += rows
    got = landing.read_sheet(spark, str(tmp_path), multi_line=True)
    assert got.rdd.getNumPartitions() > 1 and got.columns == ["source_row_number", "first", "second col", "third"]
    rows = sorted(got.collect())
    assert [r[0] for r in rows] == list(range(2, 802))
    assert [[x or "" for x in r[1:]] for r in rows] == expected
    one_task = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path))
    assert sorted(map(tuple, one_task.collect()), key=repr) == sorted((tuple(r[1:]) for r in rows), key=repr)


def test_typed_cells_fail_where_they_do_not_fit(spark, tmp_path):
    (tmp_path / "s.csv").write_text('n,t\n1,"a\nb"\n2,c\n')
    rows = landing.read_sheet(spark, str(tmp_path / "s.csv"), schema="n int, t string", multi_line=True).collect()
    assert sorted(map(tuple, rows)) == [(2, 1, "a\nb"), (3, 2, "c")]
    (tmp_path / "s.csv").write_text("n,t\nx,c\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        landing.read_sheet(spark, str(tmp_path / "s.csv"), schema="n int, t string", multi_line=True).collect()


@pytest.fixture(scope="module")
def imported(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sheets")
    files = {}
    for name, rows in ROWS.items():
        files[name] = str(folder / f"{name}.csv")
        with open(files[name], "w", encoding="utf-8", newline="") as f:
            out = csv.writer(f)
            out.writerow([c for c, _, _ in SHEETS[name]])
            out.writerows([["" if v is None else v.isoformat() if hasattr(v, "isoformat") else v for v in r] for r in rows])
    store = importing.Store(spark, str(tmp_path_factory.mktemp("warehouse")))
    return store, files, importing.import_files(store, files)


def test_files_are_known_by_their_content(imported):
    store, files, (batch_id, status) = imported
    assert status == "completed" and store.core().sales_order_lines.count() == 4
    assert importing.import_files(store, files) == (batch_id, "completed") and store.batches().count() == 1


def test_core_is_not_shuffled_for_a_batch(spark, imported):
    """Looking keys up in the core moves the batch alone: the core's side is read by bucket."""
    store, _, (batch_id, _) = imported
    from tidemark.model import Sheets
    batch = Sheets(**{n: df for n, df in input_sheets(spark).items()})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        loaded = store.loaded()
        for code, sheet in (("CORE-E001", "sales"), ("CORE-E002", "purchases"), ("CORE-E003", "inventory"), ("CORE-E004", "expedition")):
            found = rules.rule_issues(code, sheet, batch, loaded)
            tree = found._jdf.queryExecution().executedPlan().toString().split("\n")
            at = next(i for i, line in enumerate(tree) if "Bucketed: true" in line)
            path = ancestors(tree, at)
            join = next(i for i, line in enumerate(path) if "Join" in line)
            assert not any("Exchange" in line for line in path[:join]), path
            assert found.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    orphans = importing.core_violations(store.core(), store.core().replace(sales_orders=store.core().sales_orders.limit(0)), store.loaded())
    assert orphans.count() == 0     # the keys know them


def ancestors(tree, at):
    """The lines above line ``at`` in a printed plan, the nearest first."""
    def depth(line):
        mark = re.match(r"[ :]*[:+]- ", line)
        return mark.end() if mark else 0

    out, least = [], depth(tree[at])
    for line in reversed(tree[:at]):
        if depth(line) < least:
            least = depth(line)
            out.append(line)
    return out
