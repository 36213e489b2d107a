"""Small fixture inputs and expected outputs.

Fixed values: the inputs and outputs below must equal the golden ones for the results to be right.
"""

import json
import os

FOOFILE_JSON = [
    {"Foo": "first", "Bar": "row", "Baz": 123, "Fobe": 1.0, "Dt Test": "2018-10-07", "enabled": True},
    {"Foo": "second", "Bar": "row", "Baz": 456, "Fobe": 2.1, "Dt Test": "10/07/2018", "enabled": False},
    {"Foo": "third", "Bar": "row your boat", "Baz": 789, "Fobe": 3, "Dt Test": "10-18-18", "enabled": True},
    {"Foo": "fourth", "Bar": " boat ", "Baz": 0, "Fobe": 4.3, "Dt Test": "2018-10-10T14:13:30.500Z", "enabled": False},
    {"Foo": "fifth", "Bar": "downstream", "Baz": -12, "Fobe": 19, "Dt Test": "10/18/18", "enabled": True},
    {"Foo": "sixth", "Bar": None, "Baz": None, "Fobe": None, "Dt Test": None, "enabled": None},
    {"Foo": "seventh", "Bar": "big data*", "Baz": "1,000,000", "Fobe": "4,000.3",
     "Dt Test": "2018-10-10T14:13:30.000-05:00", "enabled": False},
    {"Foo": "eighth", "Bar": "(bigger data)", "Baz": 12, "Fobe": 3.44, "Dt Test": "10-OCT-18", "enabled": False},
]

FOOFILE_CSV = '''"Foo","Bar","Baz","Fobe",Dt Test,enabled
first,"row",123,1.0,2018-10-07, true
"second",row,456,2.1,10/07/2018, false
third,"row your boat", 789,3,10-18-18,true
fourth, boat ,0,4.3,2018-10-10T14:13:30.500Z,false
fifth,downstream,-12,+19,10/18/18,true
"sixth",,,,,
seventh,"big data*","1,000,000","4,000.3",2018-10-10T14:13:30.000-05:00,false
"eighth","(bigger data)",12,3.44,"10-OCT-18",false
'''

FOO_MISSING_CSV = '''"Foo","Bar","Baz","Fobe",Dt Test,enabled
first,"row",123,1.0,2018-10-07, true
"second",row,456,2.1,10/07/2018, false
third,"row your boat", 789,3,10-18-18,true
fourth, boat ,0,4.3,2018-10-10T14:13:30.500Z,false
fifth,downstream,-12,+19,10/18/18,true
"sixth",*,*,*,*,*
seventh,"big data*","1,000,000","4,000.3",2018-10-10T14:13:30.000-05:00,false
"eighth","(bigger data)",12,3.44,"10-OCT-18",false
'''

FOOFILE_PIPE = '''Foo|Bar|Baz|Fobe|Dt Test|enabled
first|row|123|1.0|2018-10-07| true
"second"|row|456|2.1|10/07/2018| false
third|"row your boat"| 789|3|10-18-18|true
fourth| boat |0|4.3|2018-10-10T14:13:30.500Z|false
fifth|downstream|-12|+19|10/18/18|true
sixth|||||
seventh|big data*|1000000|4000.3|2018-10-10T14:13:30.000-05:00|false
eighth|(bigger data)|12|3.44|10-OCT-18|false
'''

FOO_SCHEMA = {
    "name": "foo_schema",
    "fields": [
        {"name": "Foo", "type": "keyword", "size": 64, "nullable": False, "key": 1},
        {"name": "Bar", "type": "text", "size": 256},
        {"name": "Baz", "type": "integer"},
        {"name": "Fobe", "type": "number"},
        {"name": "Dt Test", "type": "date"},
        {"name": "enabled", "type": "boolean"},
    ],
}

# expected rows after applying FOO_SCHEMA (session zone America/Chicago)
FOOFILE_EXPECTED = [
    {"Foo": "first", "Bar": "row", "Baz": 123, "Fobe": 1, "Dt Test": "2018-10-07T00:00:00.000Z", "enabled": True},
    {"Foo": "second", "Bar": "row", "Baz": 456, "Fobe": 2.1, "Dt Test": "2018-10-07T05:00:00.000Z", "enabled": False},
    {"Foo": "third", "Bar": "row your boat", "Baz": 789, "Fobe": 3, "Dt Test": "2018-10-18T05:00:00.000Z", "enabled": True},
    {"Foo": "fourth", "Bar": " boat ", "Baz": 0, "Fobe": 4.3, "Dt Test": "2018-10-10T14:13:30.500Z", "enabled": False},
    {"Foo": "fifth", "Bar": "downstream", "Baz": -12, "Fobe": 19, "Dt Test": "2018-10-18T05:00:00.000Z", "enabled": True},
    {"Foo": "sixth", "Bar": None, "Baz": None, "Fobe": None, "Dt Test": None, "enabled": None},
    {"Foo": "seventh", "Bar": "big data*", "Baz": 1000000, "Fobe": 4000.3, "Dt Test": "2018-10-10T19:13:30.000Z", "enabled": False},
    {"Foo": "eighth", "Bar": "(bigger data)", "Baz": 12, "Fobe": 3.44, "Dt Test": "2018-10-10T05:00:00.000Z", "enabled": False},
]

FOOFILE_CSV_OUT = '''"Foo","Bar","Baz","Fobe","Dt Test","enabled"
"first","row",123,1,2018-10-07,true
"second","row",456,2.1,2018-10-07T05:00:00.000Z,false
"third","row your boat",789,3,2018-10-18T05:00:00.000Z,true
"fourth"," boat ",0,4.3,2018-10-10T14:13:30.500Z,false
"fifth","downstream",-12,19,2018-10-18T05:00:00.000Z,true
"sixth",,,,,
"seventh","big data*",1000000,4000.3,2018-10-10T19:13:30.000Z,false
"eighth","(bigger data)",12,3.44,2018-10-10T05:00:00.000Z,false
'''

SUBOBJ1 = {"first": {"state": "running"}, "second": {"state": "stopped"}, "third": {"state": "paused"},
           "fourth": {"state": "running"}, "fifth": {"ex-state": "down"}, "sixth": None,
           "seventh": {"state": "running"}, "eighth": {"state": "running"}}

WIDGETS = [
    {"Foo": "first", "Baz": "123", "tags": ["fun", "fast"], "widgets": [{"part": "core", "count": 12}, {"part": "screw", "count": 9}]},
    {"Foo": "second", "Baz": "456", "tags": ["unfun", "slow"], "widgets": [{"part": "core", "count": 12}, {"part": "screw", "count": 9}]},
    {"Foo": "third", "Baz": "789", "tags": ["row", "boat!"], "widgets": [{"part": "core", "count": 12}, {"part": "screw", "count": 9}]},
    {"Foo": "fourth", "Baz": "0", "tags": ["ancient", "guardian", "beast"], "widgets": [{"part": "shaft", "count": 12}, {"part": "spring", "count": 9}]},
    {"Foo": "fifth", "Baz": "-12", "tags": ["wild", "side"], "widgets": [{"part": "core", "count": 12}, {"part": "screw", "count": 9}]},
    {"Foo": "seventh", "Baz": "1,000,000", "widgets": [{"part": "gear", "count": 12}, {"part": "screw", "count": 9}, {"part": "shaft", "count": 9}]},
    {"Foo": "eighth", "Baz": "12", "widgets": [{"part": "core", "count": 0}, {"part": "screw", "count": 1000000}, {"part": "shaft", "count": 3}]},
]

POLYGONS = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [0, 1], [1, 1], [1, 0], [0, 0]]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [
            [[0, 0], [0, 4], [4, 4], [4, 0], [0, 0]], [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [
            [[[2, 2], [2, 3], [3, 3], [3, 2], [2, 2]]], [[[4, 4], [4, 5], [5, 5], [5, 4], [4, 4]]]]}},
    ],
}


def write(dirpath, name, content):
    p = os.path.join(dirpath, name)
    with open(p, "w", encoding="utf-8") as fh:
        fh.write(content if isinstance(content, str) else json.dumps(content))
    return p


def rows_as_json(df):
    """Collect rows as JSON-ready dicts (ISO timestamps) for golden comparison."""
    from skein.sinks.files import json_ready

    return [json.loads(x) for x in json_ready(df).toJSON().collect()]


def with_nulls(rows, columns):
    return [{c: r.get(c) for c in columns} for r in rows]
