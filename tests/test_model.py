import pytest

from fathom.model import CandidateWindows, Collection, Config, Field, InvalidSchema, Mode, SearchRequest, ValidationFailed, check_content, check_id
from fathom.operators.filters import Filter, Match, Range, check_against


@pytest.mark.parametrize("name", ["", "a" * 65, "a b", "é"])
def test_collection_names(name):
    with pytest.raises(InvalidSchema):
        Collection(name)


@pytest.mark.parametrize("fields", [(Field("a", "tag"), Field("a", "numeric")), (Field("chunk_index", "numeric"),), tuple(Field(f"f{i}", "tag") for i in range(65))])
def test_collection_fields(fields):
    with pytest.raises(InvalidSchema):
        Collection("c", fields)


def test_sixty_four_fields_and_dims():
    assert len(Collection("c", tuple(Field(f"f{i}", "tag") for i in range(64))).fields) == 64
    with pytest.raises(InvalidSchema):
        Collection("c", (), 0)
    for name, kind in (("id", "tag"), ("", "tag"), ("x" * 65, "tag"), ("x", "text")):
        with pytest.raises(InvalidSchema):
            Field(name, kind)


@pytest.mark.parametrize("bad", ["", "a/b", "x" * 257, "search", "collections"])
def test_ids(bad):
    with pytest.raises(ValidationFailed):
        check_id(bad)
    check_id("7")
    check_id("x" * 256)


def test_content_is_measured_in_bytes():
    check_content("a" * 163_840)
    with pytest.raises(ValidationFailed):
        check_content("é" * 90_000)
    with pytest.raises(ValidationFailed):
        check_content("")


def test_request_defaults_and_clamps():
    r = SearchRequest("q")
    assert (r.mode, r.top_k, r.limit) == (Mode.HYBRID, 10, 10)
    r = SearchRequest("q", top_k=9999, limit=9999)
    assert (r.top_k, r.limit) == (500, 100)
    for bad in ({"query": ""}, {"query": "x" * 4097}, {"query": "q", "min_score": 1.5}, {"query": "q", "mode": "fuzzy"}):
        with pytest.raises(ValidationFailed):
            SearchRequest(**bad)


def test_candidate_windows():
    w = CandidateWindows(25, 3.0, 25, 4.0)
    assert (w.knn(10, 5), w.keyword(10, 5)) == (30, 40)
    assert CandidateWindows().knn(10, 10) == 100
    assert CandidateWindows().knn(500, 100) == 1000


@pytest.mark.parametrize("spec", [
    {"must": [{"key": "a", "match": "x"}] * 33}, {"must": [{"key": "a"}]}, {"must": [{"key": "a", "match": "x", "range": {"gt": 1}}]},
    {"must": [{"key": "a", "range": {}}]}, {"must": [{"key": "a", "range": {"gt": 1, "gte": 1}}]}, {"must": [{"key": "a", "range": {"lt": 1, "lte": 1}}]},
    {"must": [{"key": "", "match": "x"}]}, {"must": [{"key": "a", "match": ""}]}, {"any": []}, {"must": [{"key": "a", "range": {"above": 1}}]},
])
def test_bad_filters(spec):
    with pytest.raises(ValidationFailed):
        Filter.parse(spec)


def test_filters_against_fields():
    c = Collection("c", (Field("category", "tag"), Field("price", "numeric")))
    check_against(Filter(must=(Match("category", "x"), Range("price", gt=1), Match("parent_doc_id", "p"), Range("chunk_index", gte=2))), c)
    for bad in (Match("price", "1"), Range("category", gt=1), Match("nope", "x")):
        with pytest.raises(InvalidSchema):
            check_against(Filter(must=(bad,)), c)


def test_config():
    c = Config.from_mapping({"batch_size": "${SIZE:-7}", "budget_action": "${ACT:-reject}"}, {"SIZE": "9"})
    assert (c.batch_size, c.budget_action) == (9, "reject")
    for bad in ({"budget_action": "x"}, {"nope": 1}, {"batch_size": 0}):
        with pytest.raises(ValidationFailed):
            Config.from_mapping(bad, {})
