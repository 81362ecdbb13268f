"""Paged documents: any page by itself, conditions before reading, pages without anything left out."""

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

from folioscope.sources import paged


def save(folder, name, pages):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.paged").write_bytes(paged.packed(pages))
    return str(folder / f"{name}.paged")


def test_pages_images_and_cleaning(spark, tmp_path):
    logo = [0, 0, 10, 10, b"logo".hex()]
    one = save(tmp_path / "d", "one", [{"text": f"Página {i} Ünï\r\n\r\n\r\n\r\nx\ty "} if i % 3 else {"text": " \n\t"} for i in range(20)])
    two = save(tmp_path / "d", "two", [{"images": [logo, [1, 2, 3, 4, "ff"]]}, {"text": "b", "images": [logo]}, {}, {"images": [logo]}, {"images": [logo, logo]}])
    save(tmp_path / "d", "none", [])
    rows = paged.read_paged(spark, str(tmp_path / "d"), 4)
    got = {(r["path"], r["page"]): r for r in rows.collect()}
    assert {k for k in got if k[0] == one} == {(one, i + 1) for i in range(20) if i % 3} and {k[1] for k in got if k[0] == two} == {1, 2, 4, 5}
    assert got[one, 2]["text"] == "Página 1 Ünï\n\nx y" and got[one, 2]["digest"] == paged.short_digest(got[one, 2]["text"].encode())
    assert got[two, 1]["images"][1].asDict() == {"x0": 1.0, "y0": 2.0, "x1": 3.0, "y1": 4.0, "digest": paged.short_digest(b"\xff")}
    assert [(r["path"], r["n_pages"]) for r in paged.repeated_images(rows).collect()] == [(two, 4)]
    assert rows.where("page > 5 AND page <= 9").count() == 2 * 1 + 1 and rows.where(f"path = '{two}'").count() == 4


def test_planning_leaves_out_what_conditions_exclude(tmp_path):
    paths = [save(tmp_path / "d", n, [{"text": str(i)} for i in range(100)]) for n in ("a", "b")]
    reader = lambda: paged.PagedReader({"path": str(tmp_path / "d"), "range": "10"})
    assert len(reader().partitions()) == 20
    some = reader()
    rest = list(some.pushFilters([GreaterThan(("page",), 35), LessThanOrEqual(("page",), 42), In(("path",), (paths[1],)), StringContains(("text",), "4")]))
    assert [type(f) for f in rest] == [StringContains]
    assert [(p.path, p.first, p.last) for p in some.partitions()] == [(paths[1], 36, 42)]
    none = reader()
    assert list(none.pushFilters([EqualTo(("page",), 101)])) == [] and none.partitions() == []
    (tmp_path / "d" / "c.paged").write_bytes(b"something else altogether")
    with pytest.raises(ValueError, match="paged"):
        reader().partitions()
