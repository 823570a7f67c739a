"""Facts leave a task in batches of bounded size, and blanks before a token are never read as one."""

import pyarrow as pa
import pytest

from meshlens.plans import shipping
from meshlens.sources import tree
from meshlens.sources.extract import script_source


def test_facts_leave_in_bounded_batches():
    n = 6000
    files = pa.RecordBatch.from_pydict({"section": ["x"] * n, "path": [f"f{k}" for k in range(n)], "content": [b"a"] * n, "sha": ["s"] * n})
    out = list(tree.fact_batches([files], {"x": lambda path, text: iter([("call", {"url": path + "u" * 1000})] * 2)}))
    assert sum(b.num_rows for b in out) == 2 * n and len(out) > 10
    assert max(b.nbytes for b in out) < 2 * tree.FACTS_A_BATCH
    assert [b.column("path")[0].as_py() for b in out][0] == "f0" and out[-1].column("path")[-1].as_py() == f"f{n - 1}"


def test_files_that_fail_or_hold_nothing():
    def parse(path, text):
        if path == "bad":
            raise RecursionError
        return iter([])

    files = pa.RecordBatch.from_pydict({"section": ["x", "x"], "path": ["bad", "none"], "content": [b"\xff", b""], "sha": ["1", "2"]})
    assert [b.column("kind").to_pylist() for b in tree.fact_batches([files], {"x": parse})] == [["failed", "none"]]


def test_batches_to_python_are_bounded(spark):
    shipping.ship(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) == shipping.BATCH_BYTES


@pytest.mark.parametrize("tail", ["// foo", "/* foo */", "/* foo", " \n", "// a\n/* b */ "])
def test_comments_at_the_end(tail):
    assert script_source.Script("f(x) " + tail).text == ["f", "(", "x", ")"]
    assert script_source.Script("`${g(" + tail).text == ["`${g(" + tail]
