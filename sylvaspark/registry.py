"""Named extension points: statistics, criteria, threshold methods and sampling methods."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self, kind: str):
        self.kind, self._items = kind, {}

    def register(self, name: str) -> Callable:
        def add(f):
            if name in self._items:
                raise ValueError(f"{self.kind} {name!r} exists")
            self._items[name] = f
            return f

        return add

    def __getitem__(self, name: str):
        if name not in self._items:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self._items))}")
        return self._items[name]

    def __contains__(self, name: str) -> bool:
        return name in self._items

    def names(self) -> list[str]:
        return sorted(self._items)


def _filled(kind: str, **items) -> Registry:
    r = Registry(kind)
    for name, f in items.items():
        r.register(name)(f)
    return r


def _load() -> tuple[Registry, ...]:
    from .functions import association as a
    from .operators import permutation as p
    from .operators import sampling, splits

    def test(kind: str):
        return lambda long, n=100, seed=0, by=None: p.permutation_test(long, n, seed, kind, by)

    def threshold_test(criterion: str):
        return lambda one, at, n=100, seed=0, by=None: p.threshold_test(one, at, n, seed, criterion, by)

    return (
        _filled("classifier statistic", mc=a.correlation_ratio, mi=a.mutual_information, rdc=lambda long, **k: a.rdc(long, task="classification", **k)),
        _filled("regressor statistic", pc=a.pearson, dc=a.distance_correlation, rdc=a.rdc),
        _filled("classifier test", mc=test("mc"), mi=test("mi"), rdc=test("rdc_class")),
        _filled("regressor test", pc=test("pc"), dc=test("dc"), rdc=test("rdc")),
        _filled("split criterion", gini=splits.gini_sweep, entropy=splits.entropy_sweep, mse=splits.mse_sweep, mae=splits.mae_sweep),
        _filled("threshold test", **{c: threshold_test(c) for c in ("gini", "entropy", "mse", "mae")}),
        _filled("threshold method", **{m: (lambda long, m=m, **k: splits.thresholds(long, m, **k)) for m in ("exact", "random", "percentile", "histogram")}),
        _filled("sampling method", **{m: (lambda rows, row_id, trees, seed, label=None, m=m, **k: sampling.bootstrap(rows, row_id, trees, seed, label, m, **k)) for m in ("classic", "stratified", "undersample", "oversample")}),
    )


CLASSIFIER_STATISTICS, REGRESSOR_STATISTICS, CLASSIFIER_TESTS, REGRESSOR_TESTS, SPLIT_CRITERIA, THRESHOLD_TESTS, THRESHOLD_METHODS, SAMPLING_METHODS = _load()
