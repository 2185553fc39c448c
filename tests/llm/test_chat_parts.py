"""Chat windows don't depend on how turns are numbered."""

import pytest


def rows(numbers):
    return [(1, n, "assistant" if k % 2 else "user", f"{k:05d} " + "x" * (k % 40)) for k, n in enumerate(numbers)]


@pytest.mark.parametrize("step", [1, 100, 7])
def test_gaps_change_no_window(spark, step):
    from riskframe.llm.chat_format import chat_windows

    schema = "conv_id long, turn long, role string, text string"
    made = {s: sorted((r.part, r.window, r.n_turns, r.formatted) for r in chat_windows(spark.createDataFrame(rows(range(0, 1000 * s, s)), schema)).collect()) for s in (1, step)}
    assert [m[2:] for m in made[1]] == [m[2:] for m in made[step]] and len(made[1]) < 120


def test_equal_numbers_and_mixed_gaps(spark):
    from riskframe.llm.chat_format import chat_windows, read_windows

    schema = "conv_id long, turn long, role string, text string"
    data = [(1, 5, "user", f"{k:05d}") for k in range(3000)] + [(2, n, "assistant", str(n)) for n in [*range(200), *range(1000, 90_000, 97)]] + [(None, k // 300, "assistant", f"{k:04d}") for k in range(700)] + [(3, None, "user", "a"), (3, 0, "assistant", "b")]
    data += [(4, 1, "user", "long " * 20_000), (4, 2, "assistant", "y")]
    windows = chat_windows(spark.createDataFrame(data, schema).repartition(7))
    size = windows.groupBy("conv_id", "part").sum("n_turns").collect()
    assert max(r["sum(n_turns)"] for r in size) <= 128
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in read_windows(windows).collect()}
    want = {}
    for c, n, role, text in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])):
        want.setdefault(c, []).append((role, text))
    assert back == want
