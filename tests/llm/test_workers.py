import pytest

from prosegauge.llm import workers


def test_memory_goes_back_when_work_ends(monkeypatch):
    ended = []
    monkeypatch.setattr(workers, "release", lambda: ended.append(1))

    @workers.trimmed
    def doubled(batches):
        """Twice."""
        for x in batches:
            yield 2 * x

    found = doubled(iter([1, 2]))
    assert next(found) == 2 and not ended
    assert list(found) == [4] and ended == [1]
    with pytest.raises(TypeError):
        list(doubled(iter([None])))
    assert ended == [1, 1] and doubled.__doc__ == "Twice."


def test_release():
    workers.release()
