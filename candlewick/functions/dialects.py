"""Window kernels as SQL text, once for Spark and once for the SQL oracle.

A kernel says what a rolling, ranked, recursive or run-length value is; the two classes say it in their engine's
terms.  Windows run over one symbol's bars in session order.  Rolling frames count rows and need a number of values
that are not null; a comparison with null is false in a flag and null elsewhere.
"""

from __future__ import annotations

import math

ORDER = "PARTITION BY symbol ORDER BY session"


def frame(n: int, lag: int = 0) -> str:
    """The last n rows, ending `lag` rows ago; negative lags look ahead."""

    def bound(k: int) -> str:
        return "CURRENT ROW" if k == 0 else f"{k} PRECEDING" if k > 0 else f"{-k} FOLLOWING"

    return f"ROWS BETWEEN {bound(n - 1 + lag)} AND {bound(lag)}"


class Spark:
    """Spark SQL."""

    name = "spark"

    def over(self, n: int, lag: int = 0) -> str:
        return f"OVER ({ORDER} {frame(n, lag)})"

    def roll(self, aggregate: str, x: str, n: int, least: int | None = None, lag: int = 0) -> str:
        w = self.over(n, lag)
        return f"CASE WHEN count({x}) {w} >= {n if least is None else least} THEN {aggregate}({x}) {w} END"

    def mean(self, x: str, n: int, least: int | None = None, lag: int = 0) -> str:
        return self.roll("avg", x, n, least, lag)

    def std(self, x: str, n: int, least: int | None = None, lag: int = 0) -> str:
        # of one value there is none
        w = self.over(n, lag)
        return f"CASE WHEN count({x}) {w} >= {max(2, n if least is None else least)} THEN stddev_samp({x}) {w} END"

    def pair(self, aggregate: str, a: str, b: str, n: int, least: int) -> str:
        w = self.over(n)
        both = f"CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN"
        return f"CASE WHEN count({both} 1 END) {w} >= {least} THEN {aggregate}({both} {a} END, {both} {b} END) {w} END"

    def corr(self, a: str, b: str, n: int, least: int) -> str:
        """Null where one of the two does not vary, in which case Spark's own corr divides by zero."""
        w = self.over(n)
        both = f"CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN"
        varies = " AND ".join(f"max({both} {x} END) {w} > min({both} {x} END) {w}" for x in (a, b))
        spread = " * ".join(f"stddev_samp({both} {x} END) {w}" for x in (a, b))
        return f"CASE WHEN {varies} THEN {self.pair('covar_samp', a, b, n, least)} / nullif({spread}, 0) END"

    def cov(self, a: str, b: str, n: int, least: int) -> str:
        return self.pair("covar_samp", a, b, n, least)

    def slope(self, y: str, n: int) -> str:
        """Least squares over n rows, all present."""
        w = self.over(n)
        return f"CASE WHEN count({y}) {w} >= {n} THEN regr_slope({y}, rn) {w} END"

    def lag(self, x: str, n: int = 1) -> str:
        return f"lag({x}, {n}) OVER ({ORDER})" if n >= 0 else f"lead({x}, {-n}) OVER ({ORDER})"

    def median(self, x: str, n: int, least: int) -> str:
        w = self.over(n)
        return f"CASE WHEN count({x}) {w} >= {least} THEN percentile({x}, 0.5D) {w} END"

    def values(self, x: str, n: int) -> str:
        return f"collect_list({x}) {self.over(n)}"

    def rank_in(self, values: str, x: str, least: int) -> str:
        """Average-tie percentile rank of x among a list of values that holds it."""
        below, same = f"size(filter({values}, v -> v < {x}))", f"size(filter({values}, v -> v = {x}))"
        return f"CASE WHEN ({x}) IS NOT NULL AND size({values}) >= {least} THEN ({below} + ({same} + 1) / 2D) / size({values}) END"

    def skew(self, x: str, n: int) -> str:
        """Bias-corrected, from the population moments that Spark has."""
        return f"({self.roll('skewness', x, n)}) * {math.sqrt(n * (n - 1)) / (n - 2)!r}D"

    def kurt(self, x: str, n: int) -> str:
        return f"(({self.roll('kurtosis', x, n)}) * {n + 1} + 6) * {(n - 1) / ((n - 2) * (n - 3))!r}D"

    def since(self, flag: str) -> str:
        """Rows since the flag last was 1, 0 before the first."""
        return f"coalesce(rn - last(CASE WHEN ({flag}) = 1 THEN rn END, true) OVER ({ORDER} ROWS UNBOUNDED PRECEDING), 0)"

    def streak(self, flag: str) -> str:
        """Rows in a row, up to this one, in which the flag is 1."""
        return f"rn - coalesce(last(CASE WHEN ({flag}) = 0 THEN rn END, true) OVER ({ORDER} ROWS UNBOUNDED PRECEDING), 0)"

    def total(self, x: str) -> str:
        return f"CASE WHEN ({x}) IS NOT NULL THEN sum({x}) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) END"

    def date_part(self, what: str) -> str:
        return {
            "weekday": "weekday(session)",
            "week_end": "date_add(session, (11 - weekday(session)) % 7)",
            "month": "CAST(trunc(session, 'MM') AS DATE)",
        }[what]

    def integer(self, x: str) -> str:
        return f"CAST({x} AS INT)"

    def log(self, x: str) -> str:
        """Null where the argument is not positive."""
        return f"CASE WHEN ({x}) > 0 THEN ln({x}) END"

    def root(self, x: str) -> str:
        return f"CASE WHEN ({x}) >= 0 THEN sqrt({x}) END"

    # lists, for the running weekly point of control
    def week_list(self) -> str:
        w = "OVER (PARTITION BY symbol, week_end ORDER BY session ROWS UNBOUNDED PRECEDING)"
        return f"collect_list(CASE WHEN typical IS NOT NULL AND volume IS NOT NULL THEN struct(typical AS p, volume AS v) END) {w}"

    def heaviest_bin(self, rows: str, low: str, high: str, bins: int = 50) -> str:
        """The number of the heaviest of equal bins, the lowest of equals."""
        place = f"least(CAST((%s.p - {low}) / ({high} - {low}) * {bins} AS INT), {bins - 1})"
        heavy = f"aggregate({rows}, 0D, (s, y) -> s + CASE WHEN {place % 'y'} = {place % 'x'} THEN y.v ELSE 0D END)"
        return f"-array_max(transform({rows}, x -> struct({heavy} AS w, -({place % 'x'}) AS b))).b"


class Duck(Spark):
    """The oracle's SQL."""

    name = "duck"

    def corr(self, a: str, b: str, n: int, least: int) -> str:
        w = self.over(n)
        both = f"CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN"
        varies = " AND ".join(f"max({both} {x} END) {w} > min({both} {x} END) {w}" for x in (a, b))
        return f"CASE WHEN {varies} THEN {self.pair('corr', a, b, n, least)} END"

    def median(self, x: str, n: int, least: int) -> str:
        w = self.over(n)
        return f"CASE WHEN count({x}) {w} >= {least} THEN quantile_cont({x}, 0.5) {w} END"

    def values(self, x: str, n: int) -> str:
        return f"list({x}) FILTER (WHERE ({x}) IS NOT NULL) {self.over(n)}"

    def rank_in(self, values: str, x: str, least: int) -> str:
        below, same = f"len(list_filter({values}, lambda v: v < {x}))", f"len(list_filter({values}, lambda v: v = {x}))"
        return f"CASE WHEN ({x}) IS NOT NULL AND len({values}) >= {least} THEN ({below} + ({same} + 1) / 2.0::DOUBLE) / len({values}) END"

    def skew(self, x: str, n: int) -> str:
        return self.roll("skewness", x, n)

    def kurt(self, x: str, n: int) -> str:
        return self.roll("kurtosis", x, n)

    def since(self, flag: str) -> str:
        return f"coalesce(rn - max(CASE WHEN ({flag}) = 1 THEN rn END) OVER ({ORDER} ROWS UNBOUNDED PRECEDING), 0)"

    def streak(self, flag: str) -> str:
        return f"rn - coalesce(max(CASE WHEN ({flag}) = 0 THEN rn END) OVER ({ORDER} ROWS UNBOUNDED PRECEDING), 0)"

    def date_part(self, what: str) -> str:
        return {
            "weekday": "CAST(isodow(session) - 1 AS INTEGER)",
            "week_end": "CAST(session + CAST((12 - isodow(session)) % 7 AS INTEGER) AS DATE)",
            "month": "CAST(date_trunc('month', session) AS DATE)",
        }[what]

    def integer(self, x: str) -> str:
        return f"CAST({x} AS INTEGER)"

    def week_list(self) -> str:
        w = "OVER (PARTITION BY symbol, week_end ORDER BY session ROWS UNBOUNDED PRECEDING)"
        return f"list({{'p': typical, 'v': volume}}) FILTER (WHERE typical IS NOT NULL AND volume IS NOT NULL) {w}"

    def heaviest_bin(self, rows: str, low: str, high: str, bins: int = 50) -> str:
        place = f"least(CAST(floor((%s.p - {low}) / ({high} - {low}) * {bins}) AS INTEGER), {bins - 1})"
        heavy = f"list_sum(list_transform({rows}, lambda y: CASE WHEN {place % 'y'} = {place % 'x'} THEN y.v ELSE 0.0 END))"
        return f"-(list_reverse_sort(list_transform({rows}, lambda x: {{'w': {heavy}, 'b': -({place % 'x'})}}))[1].b)"
