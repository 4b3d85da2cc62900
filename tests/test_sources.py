"""Build events: nested macro expansions, blank and malformed lines."""

import json

import pytest


def span(line, depth):
    own = {"file_name": f"f{depth}.rs", "byte_start": 5, "byte_end": 6, "line_start": line, "line_end": line + 1, "is_primary": True}
    if depth:
        own["expansion"] = {"macro_decl_name": f"m{depth}!", "span": span(line + 10, depth - 1), "def_site_span": {"file_name": f"d{depth}.rs", "byte_start": depth % 2, "line_start": 7, "line_end": 8}}
    return own


def event(spans, level="error", rendered="text", children=()):
    return {"reason": "compiler-message", "package_id": "p", "message": {"message": "m", "level": level, "rendered": rendered, "spans": spans, "children": [{"message": "n", "level": "note", "spans": list(children)}]}}


def test_expansions_are_unfolded_to_a_stated_depth(spark, tmp_path):
    from pyspark.sql import functions as F

    from quarry.operators.diagnostics import all_spans, cut_off, errors_only, unfolded
    from quarry.sources.tables import EXPANSIONS, build_events

    lines = [event([span(1, d)], children=[span(100, 0)]) for d in range(6)] + [event([], "warning"), event([], rendered="error: aborting due to 3 previous errors"), event(None)]
    (tmp_path / "log.json").write_text("\n".join(json.dumps(x) for x in lines) + "\n")
    rows = errors_only(build_events(spark, str(tmp_path)))
    assert rows.count() == 7
    found = rows.select(F.explode(all_spans()).alias("s")).select(unfolded(F.col("s"), EXPANSIONS).alias("places"), cut_off(F.col("s"), EXPANSIONS).alias("cut"))
    got = sorted((len(r["places"]), r["places"][-1]["file_name"], r["cut"]) for r in found.collect())
    flat = (1, "f0.rs", False)
    # of each chain the definition sites with a place (odd depths here) and the innermost call
    assert got == sorted([flat] * 7 + [(2, "f0.rs", False), (2, "f0.rs", False), (3, "f0.rs", False), (2, "f1.rs", True), (3, "f2.rs", True)])


def test_blank_lines_are_skipped_and_broken_ones_fail(spark, tmp_path):
    from quarry.sources.tables import build_events

    (tmp_path / "a.json").write_text("\n" + json.dumps(event([])) + "\n\n  \n" + json.dumps(event([])) + "\n")
    assert build_events(spark, str(tmp_path)).where("reason is not null").count() == 2
    (tmp_path / "b.json").write_text('{"reason": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        build_events(spark, str(tmp_path)).collect()
    assert build_events(spark, str(tmp_path), strict=False).where("reason is not null").count() == 2
