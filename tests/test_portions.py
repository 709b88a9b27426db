"""Steps over texts hold a bounded part of a batch, however many rows Spark puts into one."""

import tracemalloc

import pyarrow as pa
import pytest

from webstrata.functions import hashing, html, sitemap_files
from webstrata.functions.portions import portions
from webstrata.operators import schema_org

PAGE = "<html><head><title>t</title></head><body>" + "<p class=a><a href=/x>text</a></p>" * 40 + "</body></html>"
SITEMAP = "<urlset>" + "<url><loc>https://e.com/a</loc></url>" * 40 + "</urlset>"


def test_portions_cover_every_row_once():
    texts = pa.array(["a" * 10, None, "b" * 500, "", "c" * 30, "d" * 30, "é" * 20] * 3 + [None] * 9)
    for rows, size in ((2, 40), (64, 60), (1, 1), (100, 10_000)):
        parts = [texts[at].to_pylist() for at in portions(texts, rows, size)]
        assert [t for p in parts for t in p] == texts.to_pylist()
        assert all(p and len(p) <= rows and (len(p) == 1 or sum(len((t or "").encode()) for t in p) <= size) for p in parts)
    assert [texts[:0][at].to_pylist() for at in portions(texts[:0])] == [[]]


@pytest.mark.parametrize("step, rows", [
    (html._parse_batches, [PAGE]), (sitemap_files._read_batches, [SITEMAP]), (hashing._simhash_batches, [PAGE]),
    (schema_org._read_batches, ["block", '{"@type":"A","name":"' + "n" * 2000 + '"}', "https://e.com/", 0])])
def test_memory_does_not_grow_with_the_batch(step, rows):
    def peak(n: int) -> int:
        columns = tuple(pa.array([c] * n) for c in rows)
        held = 0
        pa.default_memory_pool().release_unused()
        before = pa.total_allocated_bytes()
        tracemalloc.start()
        count = 0
        for part in step(iter([columns if len(columns) > 1 else columns[0]])):
            count += len(part)
            held = max(held, pa.total_allocated_bytes() - before)
        most = tracemalloc.get_traced_memory()[1] + held
        tracemalloc.stop()
        assert count == n
        return most

    step_peak = peak(1500)
    assert peak(6000) < 1.5 * step_peak
