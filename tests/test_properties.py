"""Properties over generated values, without Spark."""

import json
import math

from hypothesis import given, settings
from hypothesis import strategies as st

from cairnframe.operators import lists
from cairnframe.sources.files import absolutize
from cairnframe.sources.strict_csv import parse

text = st.text(st.characters(exclude_categories=("Cs",)), max_size=12)


def written(v):
    if v is None:
        return "NA"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return '"' + v.replace('"', '""') + '"'
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "Inf" if v > 0 else "-Inf"
    return format(v, ".17e") if v and abs(v) < 1e300 else "0"


column = st.sampled_from([st.none() | text, st.none() | st.booleans(), st.none() | st.floats()])


@settings(max_examples=200, deadline=None)
@given(st.data(), st.lists(text, min_size=1, max_size=4, unique=True), st.integers(0, 5))
def test_csv_cells_come_back(data, names, n):
    kinds = [data.draw(column) for _ in names]
    rows = [[data.draw(k) for k in kinds] for _ in range(n)]
    document = ",".join(written(c) for c in names) + "\n" + "".join(",".join(map(written, r)) + "\n" for r in rows)
    t = parse(document)
    assert t.names == names and t.count == n
    for got, want in zip(t.rows, rows):
        for a, b in zip(got, want):
            assert a == b or (isinstance(b, float) and (math.isnan(a) and math.isnan(b) or not b or abs(b) >= 1e300 or math.isclose(a, b, rel_tol=1e-15)))


values = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**31), 2**31 - 1) | st.floats() | text,
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(text, inner, max_size=4),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(values)
def test_lists_come_back(value):
    tree = json.loads(json.dumps(lists.typed(value)))
    rows = [{n: r.get(n) for n, _ in lists._FIELDS} for r in lists.flatten(tree)]
    assert lists.unflatten(rows) == tree


@given(st.lists(st.sampled_from(["a", "b", ".", "..", ""]), max_size=8))
def test_paths_are_clean(parts):
    out = absolutize("/".join(parts), "/base/dir")
    assert out.startswith("/") and not {".", ".."} & set(out.split("/")) and (out == "/" or not out.endswith("/"))
