from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from medlode.errors import Invalid
from medlode.functions import values
from medlode.functions.dates import bounds, sought
from medlode.operators import audit, bundle
from medlode.plans.params import SortKey, decode_cursor, encode_cursor, parse
from medlode.plans.registry import from_definitions


def test_bounds():
    assert bounds("1974") == (datetime(1974, 1, 1), datetime(1975, 1, 1))
    assert bounds("1974-12") == (datetime(1974, 12, 1), datetime(1975, 1, 1))
    assert bounds("2024-02-29")[1] == datetime(2024, 3, 1)
    assert bounds("2024-01-01T10:30+01:00") == (datetime(2024, 1, 1, 9, 30), datetime(2024, 1, 1, 9, 31))
    assert bounds("2024-01-01t10:30:05.9z")[0] == datetime(2024, 1, 1, 10, 30, 5)
    for bad in ("", "24", "2024-13", "2023-02-29", "2024-01-01T10", "2024-01-01T10:30:60Z", "2024-01-01T10:30+15:00", "0000"):
        with pytest.raises(Invalid):
            bounds(bad)
    assert sought("ap2024").prefix == "ap" and sought("2024").prefix == "eq"


def test_values():
    assert values.alternatives(r"a\,b,c") == [r"a\,b", "c"]
    assert values.token(r"s\|x|c") == ("s|x", "c") and values.token("|c") == ("", "c") and values.token("a|b|c") == ("a", "b|c")
    assert values.near("1|2").metres == 5000 and values.near("1|2|x").metres == 5000 and values.near("1|2|1|mi").metres == 1609.344
    for call, bad in ((values.alternatives, "a,,b"), (values.alternatives, r"a\x"), (values.check_identifier, "a|b|c"), (values.number, "gt5"), (values.number, "abc"), (values.near, "91|0"), (values.near, "1|2|-1")):
        with pytest.raises(Invalid):
            call(bad)


@given(st.text(alphabet="ab,$|\\", max_size=12))
def test_escapes_round_trip(text):
    escaped = "".join("\\" + c if c in ",$|\\" else c for c in text)
    assert [values.plain(x) for x in values.pieces(escaped, ",")] == [text]


def test_parse_and_cursor():
    s = parse("Patient", "birthdate=eq1974&active=true,false&_sort=-_lastUpdated&_count=5")
    assert s.count == 5 and s.order == [SortKey("_lastUpdated", True), SortKey("_id")]
    at = datetime(2024, 1, 1, 1, 2, 3, 4)
    assert decode_cursor(s, encode_cursor(s, {"id": "x", "last_updated": at}))[1] == "x"
    with pytest.raises(Invalid):
        decode_cursor(parse("Patient", "_sort=-_lastUpdated"), encode_cursor(s, {"id": "x", "last_updated": at}))
    for bad in ("_offset=1", "name:exact=x", "nope=1", "_count=2049", "_count=-1", "_count=1&_count=2", "_sort=name", "_sort=_id,_id", "birthdate=x", "_after_id=", "&".join(["active=true"] * 129)):
        with pytest.raises(Invalid):
            parse("Patient", bad)


def test_audit_ranges():
    assert audit.date_range(["ge2019-08-31T23:59:30Z"])[0] == datetime(2019, 8, 31, 23, 59, 30)
    assert audit.date_range(["gt2019-08-31T23:59:30Z", "lt2020"]) == (datetime(2019, 8, 31, 23, 59, 31), datetime(2020, 1, 1))
    for bad in (["ge2018-11", "lt2018-10"], ["ne2018"], ["ap2018"]):
        with pytest.raises(Invalid):
            audit.date_range(bad)


def test_bundle_pieces():
    doc = {"a": {"reference": "urn:uuid:1#f"}, "text": {"div": "<a href='urn:uuid:1'>urn:uuid:1</a>"}, "url": "urn:uuid:1"}
    assert bundle.rewrite(doc, {"urn:uuid:1": "Patient/9"}) == {"a": {"reference": "Patient/9#f"}, "text": {"div": "<a href='Patient/9'>urn:uuid:1</a>"}, "url": "urn:uuid:1"}
    assert [bundle.if_match(x) for x in ('W/"3"', '"4"', "5")] == [3, 4, 5]
    for bad in ("*", "0", "x"):
        with pytest.raises(Invalid):
            bundle.if_match(bad)
    base = {"resourceType": "P", "id": "1", "n": [1, 2]}
    assert bundle.patch(base, [{"op": "add", "path": "/n/-", "value": 3}, {"op": "remove", "path": "/n/0"}, {"op": "test", "path": "/n/0", "value": 2}, {"op": "move", "from": "/n", "path": "/m"}]) == {"resourceType": "P", "id": "1", "m": [2, 3]}
    with pytest.raises(bundle.Unprocessable):
        bundle.patch(base, [{"op": "replace", "path": "/id", "value": "2"}])


def test_definitions():
    got = from_definitions([{"code": "onset", "type": "date", "base": ["C"], "expression": "C.onset.as(dateTime) | C.onset.as(Period)"}, {"code": "mail", "type": "token", "base": ["C"], "expression": "C.telecom.where(system='email')"}])
    assert got["C"]["onset"].path.options == ("onsetDateTime", "onsetPeriod") and got["C"]["mail"].path.value == "email"
