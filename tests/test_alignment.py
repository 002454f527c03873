import pytest

from folioflow.operators import alignment as al


def scope(i, s, e, link=None):
    return {"id": i, "source": (s, e), "link_target": link}


def aligned(source, target, pairs):
    return al.components(source, target, pairs)


def test_components_join_shared_words():
    a = aligned("a b c", "x y z", [(0, 0), (1, 0), (1, 2)])
    assert a["links"] == [([(0, 1), (2, 3)], [(0, 1), (4, 5)])] and a["unaligned"] == [(4, 5)]
    assert al.alignment_errors(a) == []
    with pytest.raises(al.AlignmentError):
        aligned("a", "x", [(0, 1)])


def test_errors_of_broken_alignments():
    a = aligned("a b", "x y", [(0, 0)])
    assert al.alignment_errors(a | {"unaligned": []}) == ["source_not_covered"]
    assert "source_overlap" in al.alignment_errors(a | {"unaligned": [(0, 3)]})
    assert "target_range_outside" in al.alignment_errors(a | {"links": [([(0, 1)], [(0, 9)])]})


def test_split_of_a_style_and_stretch_of_a_link():
    a = aligned("turned off device", "schaltete Gerät aus", [(0, 0), (1, 2), (2, 1)])
    done, issues = al.project(a, [scope("s", 0, 10)])
    assert done[0]["targets"] == [(0, 9), (16, 19)] and issues[0]["action"] == "split"
    done, issues = al.project(a, [scope("s", 0, 10, "url")])
    assert done[0]["targets"] == [(0, 19)] and issues[0]["action"] == "expanded"


def test_drops():
    a = aligned("a b c", "x y", [(0, 0), (1, 0)])
    reasons = lambda *s: [i["reason"] for i in al.project(a, list(s))[1]]
    assert reasons(scope("1", 4, 5)) == ["unresolved_source"]
    assert reasons(scope("1", 0, 1)) == ["crossing_source_boundary"]
    b = aligned("a b", "x", [(0, 0), (1, 0)]) | {"links": [], "unaligned": []}
    assert [i["reason"] for i in al.project(b, [scope("1", 0, 3)])[1]] == ["no_target"]
    assert al.diagnostic(al.project(a, [scope("1", 4, 5)])[1][0]) == "1: unresolved_source; alignment_source_ranges=[4,5)"


def test_links_that_meet_are_both_dropped_in_any_order():
    a = {"source": "a b c", "target": "x y z", "links": [([(0, 1)], [(0, 1), (4, 5)]), ([(2, 3)], [(2, 3)])], "unaligned": [(4, 5)], "ambiguous": [], "units": []}
    for order in ((0, 1), (1, 0)):
        both = [scope("l", 0, 1, "u"), scope("m", 2, 3, "v")]
        done, issues = al.project(a, [both[k] for k in order])
        assert done == [] and sorted((i["id"], i["reason"]) for i in issues) == [("l", "overlapping_links"), ("m", "overlapping_links")]


def test_complete_segments_and_units():
    a = aligned(" ab ", " xy ", [])
    assert al.project(a, [scope("s", 1, 3)], complete_segment=True)[0][0]["targets"] == [(1, 3)]
    b = aligned("a b c", "x y z", [(2, 2)]) | {"units": [((0, 3), (0, 3))]}
    assert al.project(b, [scope("s", 0, 3)])[0][0]["targets"] == [(0, 3)]


def test_markers_are_anchored_and_their_links_loosened():
    p = "DLM" + "0" * 32
    t = f"{p}X0Z"
    source, target = f"a {t} b", f"x {t} y"
    a = aligned(source, target, [(0, 0), (1, 2), (2, 1)])
    b = al.anchored(a, [t], p)
    assert ([(2, 2 + len(t))], [(2, 2 + len(t))]) in b["links"] and al.alignment_errors(b) == []
    for bad in (f"x y", f"x {t} {t}", f"x {t} {p.lower()}"):
        with pytest.raises(al.AlignmentError):
            al.anchored(a | {"target": bad}, [t], p)
    with pytest.raises(al.AlignmentError):
        al.anchored(a, [t, t], p)


def test_nearest_anchors(spark):
    scopes = spark.createDataFrame([(1, "s", 5, 8), (2, "t", 0, 1)], "pair_key long, scope_id string, start_pos int, end_pos int")
    anchors = spark.createDataFrame([(1, 0, 2), (1, 3, 5), (1, 4, 6), (1, 8, 9), (1, 20, 21)], "pair_key long, start_pos int, end_pos int")
    got = {r.scope_id: (r.before_end, r.after_start) for r in al.nearest_anchors(scopes, anchors).collect()}
    assert got == {"s": (5, 8), "t": (None, None)}
