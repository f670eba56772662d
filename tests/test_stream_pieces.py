"""A step of the streaming machines holds a domain's rows as numbers and puts them out in pieces."""

import pandas as pd

from harrow.streaming import limits


class State:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_large_domains_go_out_in_pieces(monkeypatch):
    monkeypatch.setattr(limits, "PIECE", 100, raising=False)
    step = limits._stream(lambda: limits.Breaker(2, 3.0), ["streak", "opened", "is_open", "probing", "times_opened", "rejected"], limits._broken, limits.BROKEN)
    rows = [("d", k, float(k * 7 % 250), (True, False, None)[k % 3]) for k in range(250)]
    batches = [pd.DataFrame(rows[a : a + 60], columns=["domain", "id", "t", "outcome"]) for a in range(0, 250, 60)]
    out, state = list(step(("d",), iter(batches), state := State())), state
    assert [len(x) for x in out] == [100, 100, 50]
    m = limits.Breaker(2, 3.0)
    want = [(d, i, t, *limits._broken(m, t, o)) for d, i, t, o in sorted(rows, key=lambda r: (r[2], r[1]))]
    assert [tuple(r) for x in out for r in x.itertuples(index=False)] == want
    assert state.get == (m.streak, m.opened, m.is_open, m.probing, m.times_opened, m.rejected)
