"""The meaning of the language on small documents, where fields may be missing, null or of mixed kinds."""

import json

import pytest

from fernline.engine import Engine
from fernline.errors import QueryError

#: A ship's log, a weather station, a forum thread and odd values.
DOC = {
    "log": {
        "entries": [
            {"watch": 1, "mate": {"no": 7}, "knots": [5, 6, 6], "sea": "calm"},
            {"watch": 2, "mate": {"no": 3}, "knots": [9], "sea": "rough"},
            {"watch": 3, "mate": {"no": 7}, "knots": [], "sea": "rough"},
            {"watch": 4, "mate": {"no": None}, "sea": "calm", "knots": [1, 2]},
            {"watch": 5, "mate": {}, "sea": "fog"},
            {"watch": 6, "mate": {"no": 12}, "knots": {"max": 4}, "sea": "fog"},
        ]
    },
    "crew": [{"no": 3, "called": "Olga", "rank": 2}, {"no": 7, "called": "Pim", "rank": 3, "paid": False}, {"no": None, "called": "stowaway", "rank": 1}, {"no": 20, "called": "Quy"}],
    "sensors": {"s-9": {"last": {"temp": 20, "hum": None}}, "s-1": {"last": {"temp": 18, "hum": 40}}, "s-3": {"off": True}, "s-4": {"last": {"temp": 2.5}}},
    "thread": {"say": "hello", "replies": [{"say": "hi", "replies": [{"say": "who?"}]}, {"likes": 3, "replies": {"say": "lone"}}]},
    "mixed": [{"id": "a", "v": "s"}, {"id": "b", "v": 1}, {"id": "c", "v": True}, {"id": "d", "v": None}, {"id": "e", "v": [1, 2]}, {"id": "f", "v": {"k": 1}}, {"id": "g"}],
    "readings": [
        {"at": 600, "gauge": "rain", "mm": 4}, {"at": 610, "gauge": "snow", "mm": 11}, {"at": 615, "gauge": "rain"}, {"at": 640, "gauge": "rain", "mm": 2},
        {"at": 700, "gauge": None, "mm": 1}, {"at": 705, "mm": 30}, {"at": 720, "gauge": "snow", "mm": 11},
    ],
    "marks": [{"k": 1, "n": 1}, {"k": 1.0, "n": 2}, {"k": "1", "n": 3}, {"k": None, "n": 4}, {"n": 5}, {"k": [1], "n": 6}, {"k": True, "n": 7}, {"k": 1.5, "n": 8}],
    "sums": [{"x": 6, "y": 3, "z": 2}, {"x": 1, "y": 0, "z": -1}, {"x": "5", "y": True}],
    "weird key": {"a b": [7, 8, 9]},
    "grid": [[1, 2], [3, 4], [5]],
    "text": [{"s": "  Hello  ", "p": "a*b"}, {"s": "100%_x", "p": "100*x"}, {"s": " pad ", "p": "?"}, {"s": "line\nbreak", "p": "line*"}],
    "big": [9007199254740993, 1e22, 0.1, -0.5, 1.005],
}


@pytest.fixture(scope="module")
def run(spark):
    engine = Engine.json_text(spark, json.dumps(DOC))
    return lambda text, **params: engine.run(text, params).rows


def ids(rows, name="id"):
    return [r[name] for r in rows]


CASES = {
    # presence and null
    "from .mixed[] as m where m.v exists select { id: m.id }": list("abcdef"),
    "from .mixed[] as m where m.v != null select { id: m.id }": list("abcef"),
    "from .mixed[] as m where m.v == null select { id: m.id }": ["d"],
    "from .mixed[] as m where m.v is not string select { id: m.id }": list("bcdef"),
    "from .mixed[] as m where m.v is array or m.v is object select { id: m.id }": ["e", "f"],
    "from .mixed[] as m where m.v is number or m.v is bool or m.v is null select { id: m.id }": ["b", "c", "d"],
    "from .mixed[] as m where m.v select { id: m.id }": list("abcef"),
    "from .mixed[] as m where not m.v select { id: m.id }": ["d"],
    "from .mixed[] as m where not (m.v == 1) select { id: m.id }": list("acdef"),
    "from .mixed[] as m where not (m.v == 1 and true) select { id: m.id }": list("acdefg"),
    "from .mixed[] as m where m.v != 1 select { id: m.id }": list("acdef"),
    "from .mixed[] as m where m.v > 0 select { id: m.id }": ["b"],
    "from .mixed[] as m where m.v >= null select { id: m.id }": ["d"],
    'from .mixed[] as m where m.v in ["s", 1] select { id: m.id }': ["a", "b"],
    'from .mixed[] as m where not (m.v in ["s"]) select { id: m.id }': list("bcdef"),
    'from .mixed[] as m where not (m.v in ["s", 1]) select { id: m.id }': list("cdefg"),
    'from .mixed[] as m where m.v not in ["s", 1] select { id: m.id }': list("cdef"),
    "from .mixed[] as m where m.v in [] select { id: m.id }": [],
    "from .mixed[] as m where m.v not in [] select { id: m.id }": list("abcdefg"),
    "from .mixed[] as m where m.v == m.v select { id: m.id }": list("abcd"),
    "from .mixed[] as m select { id: m.id, v: m.v } order by .v": ["d", "g", "c", "b", "a", "e", "f"],
    "from .mixed[] as m select { id: m.id, v: m.v } order by m.v desc limit 3": ["e", "f", "a"],
    # distinct: the first row of each key in document order
    "from .readings[] as r distinct by r.gauge select { id: r.at }": [600, 610, 700, 705],
    "from .readings[] as r distinct by r.gauge, r.mm select { id: r.at }": [600, 610, 615, 640, 700, 705],
    "from .mixed[] as m distinct by m.nope select { id: m.id }": ["a"],
    "from .log.entries[] as e unnest e.knots as k distinct select { id: k }": [5, 9, 1],
    # unnest: arrays only, and rows without elements go
    "from .log.entries[] as e unnest e.knots as k select { id: k }": [5, 6, 6, 9, 1, 2],
    "from .log.entries[] as e where e.knots[] > 5 select { id: e.watch }": [1, 2],
    # subqueries
    "from .crew[] as c where (from .log.entries[] as e where e.mate.no == c.no) exists select { id: c.called }": ["Olga", "Pim", "stowaway"],
    'from .crew[] as c where not (from .log.entries[] as e where e.mate.no == c.no and e.sea == "rough") exists select { id: c.called }': ["stowaway", "Quy"],
    "from .crew[] as c where c.no in (from .log.entries[].mate.no as k) select { id: c.called }": ["Olga", "Pim", "stowaway"],
    "from .crew[] as c where c.no not in (from .log.entries[].mate.no as k) select { id: c.called }": ["Quy"],
    "from .crew[] as c where (from .log.entries[] as e where e.mate.no == c.no aggregate { n: count() } by e.sea having .n > 0) exists select { id: c.called }": ["Olga", "Pim", "stowaway"],
    "from .crew[] as c where (from .log.entries[] as e where e.mate.no == c.no aggregate { n: count() } by e.mate.no having .n > 1) exists select { id: c.called }": ["Pim"],
    # field sets: every field of the set must pass
    "from .sensors[].last as l where l.{temp, hum} != null select { id: l.temp }": [18],
    "fields F = { temp } from .sensors[].last as l where l.{...F, hum: 40} == 18 select { id: l.hum }": [40],
    # text
    "from .text[] as t where t.s matches t.p select { id: t.s }": ["100%_x", "line\nbreak"],
    'from .text[] as t where t.s matches "100%?x" select { id: t.s }': ["100%_x"],
    'from .text[] as t where t.s contains "o" and t.s starts_with "  H" and t.s ends_with " " select { id: trim(t.s) }': ["Hello"],
}


@pytest.mark.parametrize("text", CASES)
def test_rows(run, text):
    assert ids(run(text)) == CASES[text]


VALUES = {
    "from .grid[][] as x": [1, 2, 3, 4, 5],
    "from .grid[1] as x": [[3, 4]],
    "from .grid[-1][0] as x": [5],
    'from .["weird key"]["a b"][-1] as x': [9],
    "from .sensors[].last.hum as h": [40, None],  # members of an object go by name
    "from .thread.**.say as s": ["hello", "hi", "who?", "lone"],
    "from .thread.**.replies[].say as s": ["hi", "who?"],
    "from .thread.replies[1].likes as x": [3],
    "from .thread.nope as x": [],
    "from .big[] as x where x > 0 and x < 1": [0.1],
    "from .readings[] as r aggregate { n: count(), t: sum(r.mm), none: sum(r.nope), d: sum(r.nope) ?? -1 }": [7, 59, None, -1],
    "from .readings[] as r aggregate { n: count(), most: max(r.mm) } by r.gauge": [{"gauge": None, "n": 1, "most": 1}, {"gauge": "rain", "n": 3, "most": 4}, {"gauge": "snow", "n": 2, "most": 11}],
    "from .readings[] as r where r.at < 700 aggregate { n: count() } by r.gauge, r.mm": [{"gauge": "rain", "mm": 2, "n": 1}, {"gauge": "rain", "mm": 4, "n": 1}, {"gauge": "snow", "mm": 11, "n": 1}],
    "from .marks[] as k aggregate { n: count(), s: sum(k.n) } by k.k": [{"k": None, "n": 1, "s": 4}, {"k": True, "n": 1, "s": 7}, {"k": 1, "n": 2, "s": 3}, {"k": 1.5, "n": 1, "s": 8}, {"k": "1", "n": 1, "s": 3}],
    "from .log.entries[] as e unnest e.knots as k where e.mate.no != null aggregate { far: sum(k) } by rollup(e.mate.no, e.sea)": [
        {"no": 3, "sea": "rough", "far": 9}, {"no": 7, "sea": "calm", "far": 17}, {"no": 3, "sea": None, "far": 9}, {"no": 7, "sea": None, "far": 17}, {"no": None, "sea": None, "far": 26}],
    "from .mixed[] as m aggregate { all: count(), some: count(m.v), sum: sum(m.v), low: min(m.v), avg: avg(m.v) }": [7, 5, 2, 1, 1],
    "from .mixed[] as m aggregate { n: count() where m.v is string or m.v is number, s: sum(m.v) where m.v is string ?? 0 } by true": [{"key": True, "n": 2, "s": 0}],
    "from .log.entries[] as e aggregate { n: count(e.knots[]), m: count(e.knots) }": [7, 5],
    "from .readings[] as r where r.mm > 1 collect by r.gauge": [[{"at": 600, "gauge": "rain", "mm": 4}, {"at": 640, "gauge": "rain", "mm": 2}], [{"at": 610, "gauge": "snow", "mm": 11}, {"at": 720, "gauge": "snow", "mm": 11}]],
    "from .readings[] as r collect by r.gauge having length(.) > 2 select { n: length(.), last: .[-1].at }": [{"n": 3, "last": 640}],
    "from .readings[] as r aggregate { n: count() } having .n > 0": [],
    "from .readings[] as r aggregate { n: count() } by r.gauge having .n > 2 select { g: .gauge, twice: .n * 2 }": [{"g": "rain", "twice": 6}],
    "from .nope[] as x aggregate { n: count(), s: sum(x.y), d: max(x) ?? 0 }": [0, None, 0],
    "from .nope[] as x aggregate { n: count() } by x.y": [],
    "from .sums[] as r select { a: r.x + r.y * r.z, b: (r.x + r.y) * r.z, c: r.x / r.y, d: -r.x, e: r.nope + 1 }": [{"a": 12, "b": 18, "c": 2, "d": -6, "e": None}, {"a": 1, "b": -1, "c": None, "d": -1, "e": None}, {"a": None, "b": None, "c": None, "d": None, "e": None}],
    "from .sums[] as r aggregate { s: sum(r.y), r: round(sum(r.x) / count(), 2) }": [4, 2.33],
    "from .mixed[] as m select { t: if(m.v, 1, 0) }": [{"t": x} for x in (1, 1, 1, 0, 1, 1, 0)],
    'from .mixed[] as m where m.id in ["a", "b", "g"] select { t: if(m.v is string, m.v, m.id is null), o: { v: m.v, l: [m.id, m.nope] } }': [
        {"t": "s", "o": {"v": "s", "l": ["a", None]}}, {"t": False, "o": {"v": 1, "l": ["b", None]}}, {"t": False, "o": {"v": None, "l": ["g", None]}}],
    "from .mixed[] as m select { n: length(m.v) }": [{"n": x} for x in (1, None, None, 0, 2, 1, 0)],
    "from .crew[] as c select { c: c.called, n: (from .log.entries[] as e where e.mate.no == c.no aggregate { n: count() }), far: (from .log.entries[] as e unnest e.knots as k where e.mate.no == c.no aggregate { s: sum(k) }) }": [
        {"c": "Olga", "n": 1, "far": 9}, {"c": "Pim", "n": 2, "far": 17}, {"c": "stowaway", "n": 1, "far": 3}, {"c": "Quy", "n": 0, "far": None}],
    # a subquery of many values where one is wanted gives the first in document order, or by its own order
    "from .crew[] as c select { c: c.called, first: (from .log.entries[] as e where e.mate.no == c.no select { w: e.watch, s: e.sea }) }": [
        {"c": "Olga", "first": {"w": 2, "s": "rough"}}, {"c": "Pim", "first": {"w": 1, "s": "calm"}}, {"c": "stowaway", "first": {"w": 4, "s": "calm"}}, {"c": "Quy", "first": None}],
    "from .crew[] as c select { c: c.called, last: (from .log.entries[] as e where e.mate.no == c.no select { w: e.watch } order by .w desc) }": [
        {"c": "Olga", "last": {"w": 2}}, {"c": "Pim", "last": {"w": 3}}, {"c": "stowaway", "last": {"w": 4}}, {"c": "Quy", "last": None}],
    "from .crew[] as c where c.rank > 1 select { c: c.called, group: (from .log.entries[] as e where e.mate.no == c.no aggregate { n: count() } by e.sea) }": [
        {"c": "Olga", "group": {"sea": "rough", "n": 1}}, {"c": "Pim", "group": {"sea": "calm", "n": 1}}],
    "from .crew[] as c where c.rank exists aggregate { t: sum((from .readings[].mm as m where (from .crew[] as d where d.no == 99) exists or m > c.rank)), n: count((from .readings[].mm as m where m > c.rank)), low: avg((from .readings[].mm as m where m > 10)), h: max((from .readings[].mm as m)) }": [170, 13, pytest.approx(52 / 3), 30],
    "from .log.entries[] as e join .crew[] as c on c.no == e.mate.no select { w: e.watch, c: c.called }": [{"w": 1, "c": "Pim"}, {"w": 2, "c": "Olga"}, {"w": 3, "c": "Pim"}, {"w": 4, "c": "stowaway"}],
    "from .log.entries[] as e left join .crew[] as c on e.mate.no == c.no where c == null or c.paid == false select { w: e.watch, c: c.called, all: c }": [
        {"w": 1, "c": "Pim", "all": {"called": "Pim", "no": 7, "paid": False, "rank": 3}}, {"w": 3, "c": "Pim", "all": {"called": "Pim", "no": 7, "paid": False, "rank": 3}}, {"w": 5, "c": None, "all": None}, {"w": 6, "c": None, "all": None}],
    "from .log.entries[] as e join .crew[] as c on c.no == e.mate.no and c.rank == e.watch aggregate { n: count(), who: max(c.no) }": [2, 7],
    "from .log.entries[] as e let long = max(e.watch), short = min(e.watch) aggregate { both: long + short, part: round(short / long, 3), o: { l: long, none: sum(e.x) ?? 0 } } by e.sea": [
        {"sea": "calm", "both": 5, "part": 0.25, "o": {"l": 4, "none": 0}}, {"sea": "fog", "both": 11, "part": 0.833, "o": {"l": 6, "none": 0}}, {"sea": "rough", "both": 5, "part": 0.667, "o": {"l": 3, "none": 0}}],
    "from .text[] as t select { a: substr(t.s, 1, 2), b: substr(t.s, -5, 3), c: substr(t.s, 1, -1), d: trim(t.s), e: replace(t.s, \"l\", \"L\"), f: upper(t.p) } limit 1": [{"a": " H", "b": "  H", "c": "", "d": "Hello", "e": "  HeLLo  ", "f": "A*B"}],
    "from .text[2].s as s select { t: trim(s), n: length(s) }": [{"t": "pad", "n": 5}],
    "from .big[] as x select { r: round(x, 2), f: floor(x), c: ceil(x), q: sqrt(x), m: mod(x, 0.3), p: pow(x, 500), a: abs(x) }": [
        {"r": 9007199254740992, "f": 9007199254740992, "c": 9007199254740992, "q": 94906265.62425156, "m": pytest.approx(0.3, abs=0.31), "p": None, "a": 9007199254740992},
        {"r": 1e22, "f": 1e22, "c": 1e22, "q": 1e11, "m": pytest.approx(0.15, abs=0.16), "p": None, "a": 1e22}, {"r": 0.1, "f": 0, "c": 1, "q": pytest.approx(0.316227766), "m": 0.1, "p": 0, "a": 0.1},
        {"r": -0.5, "f": -1, "c": 0, "q": None, "m": pytest.approx(-0.2), "p": pytest.approx(0), "a": 0.5}, {"r": 1.0, "f": 1, "c": 2, "q": pytest.approx(1.0024968), "m": pytest.approx(0.105), "p": pytest.approx(12.1, abs=0.1), "a": 1.005}],
    "from .sums[0] as r select { a: round(2.5), b: round(-2.5), c: round(1234, -2), d: lower(5), e: abs(\"x\"), f: length(\"hé\") }": [{"a": 3, "b": -3, "c": 1200, "d": None, "e": None, "f": 2}],
    "from .readings[] as r where r.mm >= $least and r.gauge == $kind select { at: r.at }": [{"at": 610}, {"at": 720}],
    "from .readings[] as r limit 2": [{"at": 600, "gauge": "rain", "mm": 4}, {"at": 610, "gauge": "snow", "mm": 11}],
}


@pytest.mark.parametrize("text", VALUES)
def test_values(run, text):
    params = {"least": 3, "kind": "snow"} if "$" in text else {}
    assert run(text, **params) == VALUES[text]


@pytest.mark.parametrize(
    "text",
    [
        "from .a[] as a where b.x == 1", "from .a[] as a join .b[] as a on a.x == a.y", "from .a[] as a join .b[] as b on a.x == a.y", "from .a[] as a join .b[] as b on b.x > a.y", "from .a[] as a join .b[] as b on b.x == a.y or b.z == a.z", "from .a[] as a where a.x == $p",
        "from .a[] as a aggregate { n: count() } by a.x select { y: a.x }", "from .a[] as a aggregate { n: count() + a.x }", "from .a[] as a let t = sum(a.x) where a.y", "from .a[] as a let t = sum(a.x) select { y: 1 }", "from .a[] as a let a = sum(a.x) aggregate { n: a }",
        "from .a[] as a aggregate { x: count() } by a.x", "from .a[] as a where (from .b[] as a where a.x == 1) exists", "from .a[] as a join a.items[] as b on b.x == a.x",
    ],
)
def test_compile_errors(run, text):
    with pytest.raises(QueryError):
        run(text)


def test_unknown_table(spark):
    with pytest.raises(QueryError, match="no such table"):
        Engine.parquet(spark, "/root/testdata/sf0.001", ["nation"]).query("from .nope[] as x")


def test_descent_loses_nothing(spark):
    """Values are followed 32 levels deep, and a document with deeper ones is an error, not a part of the answer."""
    def nest(levels):
        value = {"k": 0}
        for i in range(1, levels):
            value = {"k": i, "in": [value] if i % 2 else value}
        return Engine.json_text(spark, json.dumps({"t": value}))

    assert sorted(nest(18).run("from .t.**.k as x").rows) == list(range(18))
    with pytest.raises(Exception, match="deeper than 32"):
        nest(40).run("from .t.**.k as x")
