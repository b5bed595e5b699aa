from sondeflow.llm.common import POWERS, tidy


def test_tidy_passes_batches_on_and_forgets():
    POWERS.get(10)
    assert list(tidy(lambda b: (x + 1 for x in b))(iter([1, 2]))) == [2, 3]
    assert POWERS.n == 0
