"""Plain versions that more than one test compares with."""

from __future__ import annotations

import functools

import numpy as np

from liftgauge.llm import quality


def kept_by_exact_quantiles(table):
    """Which of the measured rows, by key, the quality rules keep; every quantile from the sorted values."""
    def ratios(r, free=0):
        return {"symbol_ratio": max(r.n_symbols - free, 0) / r.word_chars if r.word_chars else None,
                "dup_line_ratio": max(r.n_dup_lines - free, 0) / r.n_lines if r.n_lines else None,
                "word_length": r.word_chars / r.n_words if r.n_words else None}

    def quantile(values, share):
        return sorted(values)[max(int(np.ceil(share * len(values))) - 1, 0)] if values else None

    good, wider = [r for r in table.values() if not r.base_failed], quality.WIDER_TEXTS

    def drawn(of, lang, source):
        levels = [good, [r for r in good if r.lang == lang], [r for r in good if (r.lang, r.source) == (lang, source)]]
        out = of(levels[0])
        for own in levels[1:]:
            value = of(own)
            if value is not None:
                out = (len(own) * value + wider * out) / (len(own) + wider)
        return out

    @functools.cache
    def limits(lang, source):
        out = {}
        for name, least in quality.LEAST_SPREAD.items():
            at = lambda share: lambda rs: quantile([ratios(x)[name] for x in rs], share)  # noqa: B023, E731
            gap = lambda a, b: lambda rs: (at(b)(rs) - at(a)(rs) or (0 if rs is good else None)) if rs else None  # noqa: B023, E731
            spreads = [drawn(gap(a, b), lang, source) for a, b in ((0.25, 0.75), (0.5, 0.9))]
            spread = 4 * max(next((s for s in spreads if s), least), least)
            out[name] = drawn(at(0.25), lang, source) - spread, drawn(at(0.75), lang, source) + spread, spread
        return drawn(lambda rs: quantile([x.n_words for x in rs], 0.5), lang, source), out

    def kept(r):
        if r.base_failed:
            return False
        usual, of = limits(r.lang, r.source)
        for name, (low, high, spread) in of.items():
            more = spread * (max(1, (usual / r.n_words) ** 0.5) - 1) if name == "word_length" else 0
            if not low - more <= ratios(r, 1)[name] <= high + more:
                return False
        return True

    return {i: kept(r) for i, r in table.items()}
