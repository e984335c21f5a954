"""Who has an action on some object, and single checks: neither lists what it need not."""

import os

import pytest
from grantlake.catalog.queries import QUERIES
from grantlake.catalog.world import World
from grantlake.operators import engine as at
from grantlake.operators.actors import acting
from grantlake.operators.engine import SUBJECT, Engine, Evaluation, Named
from grantlake.operators.secure import tool

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("action", ["read", "others", "order", "both", "signed_in"])
def test_reaching_is_the_subjects_of_all_rows(spark, action):
    w = World(spark, SF)
    rows = lambda df: sorted(map(tuple, df.select(*SUBJECT).collect()))
    listed = w.engine().accessible(w.users(1), action, "docs/document").select(*SUBJECT).distinct()
    assert rows(w.engine().reaching(w.users(1), action, "docs/document")) == rows(listed)


def test_existence_lists_no_objects(spark, monkeypatch):
    def fails(*_, **__):
        raise AssertionError("all rows are listed")

    monkeypatch.setattr(Engine, "accessible", fails)
    monkeypatch.setattr(Named, "listed", fails)
    assert QUERIES["scoped_exists_by_user"](spark, SF).count() == World(spark, SF).users().count()


def test_single_checks_follow_edges_up_in_a_large_store(spark, monkeypatch):
    """A frame of values has no estimate, so it never was small beside the store."""
    seen, narrow = [], Evaluation.narrow

    def noted(self, asked):
        narrow(self, asked)
        seen.append(self)

    monkeypatch.setattr(Evaluation, "narrow", noted)
    engine = World(spark, SF).engine()
    plain = [engine.has_access(f"auth/user:{u}", "read", f"docs/folder:{f}") for u in (0, 7) for f in (0, 13)]
    assert not seen  # a small store is read as it is
    monkeypatch.setattr(at, "NARROW", 0)
    assert [engine.has_access(f"auth/user:{u}", "read", f"docs/folder:{f}") for u in (0, 7) for f in (0, 13)] == plain
    assert len(seen) == 4 and all(e.narrowed for e in seen)
    assert sorted(r[0] for r in seen[0].targets["docs/folder"].collect()) == ["0"]
    seen.clear()
    nowhere = tool(engine, "docs/document", "create", relations={"folder": "at"})(lambda at=None: True)
    with acting("auth/user:0"):
        assert tool(engine, "docs/document", "create", relations={"folder": "at"})(lambda at=None: True)(at="docs/folder:0")
        with pytest.raises(Exception, match="may not create"):
            nowhere()
    assert "docs/folder" in seen[0].targets and "docs/folder" not in seen[1].targets
