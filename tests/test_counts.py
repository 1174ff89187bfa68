from hindcast.plans import queries as Q


def test_counts_of_draws_are_those_of_the_reference(monkeypatch):
    seen = {}
    fake = lambda name, at: lambda *a, **how: seen.setdefault(name, []).append(how["draws"] if at is None else a[at:]) or Fake()

    class Fake:
        def __getattr__(self, _):
            return lambda *a, **how: self

    for name in ("_panel", "_state", "_paired", "_out"):
        monkeypatch.setattr(Q, name, lambda *a: Fake())
    monkeypatch.setattr(Q, "_models", lambda *a: (Fake(), Fake()))
    monkeypatch.setattr(Q.F, "avg", lambda *a: Fake())
    monkeypatch.setattr(Q.F, "lit", lambda *a: Fake())
    for where, names in ((Q.M, ("window_knn", "scored", "risk")), (Q.D, ("null_scores", "randomisation_p"))):
        for name in names:
            monkeypatch.setattr(where, name, lambda *a, **how: Fake())
    for where, name, at in ((Q.D, "drawn", 2), (Q.D, "recency_matched", 2), (Q.T, "topology_knn", None), (Q.M, "garch_t", None), (Q.T, "shuffle_test", 2), (Q.I, "bootstrap_intervals", None), (Q.I, "model_confidence_sets", None)):
        monkeypatch.setattr(where, name, fake(name, at))
    for name in ("random_control", "randomisation_test", "recency_control", "permuted_topology_control", "garch_forecasts", "shuffle_test", "block_intervals", "confidence_set"):
        Q.QUERIES[name](None, None)
    assert seen == {"drawn": [(500,), (500,)], "recency_matched": [(500,)], "topology_knn": [500], "garch_t": [20_000], "shuffle_test": [(100, 25)], "bootstrap_intervals": [2000], "model_confidence_sets": [2000]}
