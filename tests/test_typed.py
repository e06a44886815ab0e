"""Nested native columns: structs, arrays of structs, maps, decimals and times."""

import datetime
import decimal
import json

import pytest

from fernline.engine import Engine
from fernline.sources.catalog import Catalog

#: Concerts with their pieces, halls, and the seats sold.
DOC = {
    "concerts": [
        {"no": 1, "hall": {"code": "big", "row": 4}, "open": True, "pieces": [{"by": "Bach", "minutes": 12}, {"by": "Ravel", "minutes": 15}, {"by": "Bach", "minutes": 3}]},
        {"no": 2, "hall": {"code": "attic", "row": None}, "open": False, "pieces": [{"by": "Cage", "minutes": 4}]},
        {"no": 3, "hall": {"code": "big", "row": 9}, "open": True, "pieces": []},
        {"no": 4, "hall": None, "open": True, "pieces": None},
    ],
    "halls": [{"code": "big", "seats": [[1, 2], [3]], "organ": {"pipes": 900}}, {"code": "yard", "seats": [], "organ": None}],
    "sold": [2.5, 0.5, 1.0],
}
CASES = {
    "from .concerts[] as c join .halls[] as h on h.code == c.hall.code unnest c.pieces as p where c.open aggregate { pieces: count(), minutes: sum(p.minutes) } by h.organ.pipes": [{"pipes": 900, "pieces": 3, "minutes": 30}],
    "from .concerts[] as c unnest c.pieces as p aggregate { minutes: sum(p.minutes) } by p.by order by .minutes desc": [{"by": "Bach", "minutes": 15}, {"by": "Ravel", "minutes": 15}, {"by": "Cage", "minutes": 4}],
    "from .concerts[] as c aggregate { m: sum(c.pieces[].minutes), n: count(c.pieces[].by), a: avg(c.pieces[].minutes), low: min(c.pieces[].minutes) } by c.open": [{"open": False, "m": 4, "n": 1, "a": 4, "low": 4}, {"open": True, "m": 30, "n": 3, "a": 10, "low": 3}],
    'from .concerts[] as c where c.pieces[].by == "Ravel" select { no: c.no, first: c.pieces[0].by, last: c.pieces[-1].minutes, n: length(c.pieces) }': [{"no": 1, "first": "Bach", "last": 3, "n": 3}],
    "from .concerts[].pieces[] as p where p.minutes > 3 select { b: p.by }": [{"b": "Bach"}, {"b": "Ravel"}, {"b": "Cage"}],
    "from .concerts[].pieces[].minutes as m where m > 10": [12, 15],
    "from .halls[].seats[][] as s": [1, 2, 3],
    "from .sold[] as n where n >= 1 order by n": [1.0, 2.5],
    "from .concerts[] as c where c.hall.row exists select { no: c.no }": [{"no": 1}, {"no": 2}, {"no": 3}],
    "from .halls[] as h where h.organ == null or h.organ is object select { c: h.code, o: h.organ }": [{"c": "big", "o": {"pipes": 900}}, {"c": "yard", "o": None}],
    "from .concerts[] as c distinct by c.hall.code select { no: c.no }": [{"no": 1}, {"no": 2}, {"no": 4}],
    "from .halls[] as h left join .concerts[] as c on c.hall.code == h.code and c.open == h.nope select { h: h.code, c: c.no }": [{"h": "big", "c": None}, {"h": "yard", "c": None}],
    "from .halls[] as h left join .concerts[] as c on c.hall.code == h.code where c == null or c.no > 1 select { h: h.code, c: c.no, none: c is null }": [{"h": "big", "c": 3, "none": False}, {"h": "yard", "c": None, "none": True}],
    "from .concerts[] as c collect by c.open select { n: length(.), ids: .[].no }": [{"n": 1, "ids": 2}, {"n": 3, "ids": 1}],
    "from .halls[].** as x where x is string": ["big", "yard"],
    "from .concerts[] as c where (from .halls[] as h where h.code == c.hall.code and h.organ.pipes > 100) exists select { no: c.no }": [{"no": 1}, {"no": 3}],
    "from .halls[] as h select { h: h.code, rows: (from .concerts[] as c where c.hall.code == h.code aggregate { s: sum(c.hall.row) }), one: (from .sold[] as a where a > 1 select { a: a } limit 1) }": [{"h": "big", "rows": 13, "one": {"a": 2.5}}, {"h": "yard", "rows": None, "one": {"a": 2.5}}],
    "from .halls[] as h select { h: h.code, first: (from .concerts[] as c where c.hall.code == h.code select { no: c.no, row: c.hall.row }) }": [{"h": "big", "first": {"no": 1, "row": 4}}, {"h": "yard", "first": None}],
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("typed") / "doc.json"
    path.write_text(json.dumps(DOC))
    return Engine(Catalog.json(spark, str(path), typed=True))


@pytest.mark.parametrize("text", CASES)
def test_typed(engine, text):
    assert engine.run(text).rows == CASES[text]


def test_other_types(spark):
    rows = [(1, decimal.Decimal("1.50"), datetime.datetime(2024, 1, 2, 3, 4, 5), {"a": 1, "b": 2}, True, b"x"), (2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, d decimal(9,2), t timestamp, m map<string,int>, b boolean, raw binary")
    engine = Engine(Catalog().add("r", df, "id"))
    assert engine.run('from .r[] as r where r.t > "2024-01-01" and r.d == 1.5 and r.b and r.m.a == 1 select { n: length(r.m), x: r.m.z, v: r.d + 1, k: r.t is string }').rows == [{"n": 2, "x": None, "v": 2.5, "k": True}]
    assert engine.run("from .r[] as r where r.d == null select { id: r.id, n: length(r.m), s: r.d + 1 }").rows == [{"id": 2, "n": 0, "s": None}]
    assert engine.run("from .r[] as r unnest r.m as x").rows == []
    assert engine.run("from .r[].m[] as v").rows == [1, 2]
    assert engine.run("from .r[] as r aggregate { n: count(), s: sum(r.b) } by r.b").rows == [{"b": None, "n": 1, "s": None}, {"b": True, "n": 1, "s": 1}]
