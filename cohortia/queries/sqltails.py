"""Tail probabilities as SQL text, for the oracles only: series written independently of the library's own code."""


def _beta_series(a: str, b: str, x: str, terms: int) -> str:
    """Incomplete beta by its all-positive power series; converges for x below about (a+1)/(a+b+2)."""
    t = (f"exp(lgamma({a}+{b}+zi) - lgamma({a}+1.0+zi) - lgamma({b}) + ({a}+zi)*ln({x}) + {b}*ln(1.0-{x}))")
    return f"list_sum(list_transform(range({terms}), lambda zi: {t}))"


def betainc(a: str, b: str, x: str, terms: int = 1500) -> str:
    """I_x(a, b), choosing the side on which the series converges fast."""
    lo = _beta_series(a, b, x, terms)
    hi = _beta_series(b, a, f"(1.0-{x})", terms)
    return f"(CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 WHEN {x} < 0.9 THEN {lo} ELSE 1.0 - {hi} END)"


def f_sf(f: str, d1: str, d2: str) -> str:
    return betainc(f"({d2}/2.0)", f"({d1}/2.0)", f"({d2}/({d2}+{d1}*{f}))")


def t_sf2(t: str, df: str) -> str:
    return betainc(f"({df}/2.0)", "0.5", f"({df}/({df}+({t})*({t})))")


def chi2_sf(x: str, k: str, terms: int = 600) -> str:
    """1 - P(k/2, x/2) by the power series of the lower incomplete gamma function."""
    s, y = f"({k}/2.0)", f"({x}/2.0)"
    t = f"exp(({s}+zi)*ln({y}) - {y} - lgamma({s}+1.0+zi))"
    return f"(CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(1.0 - list_sum(list_transform(range({terms}), lambda zi: {t})), 0.0) END)"


def lchoose(n: str, k: str) -> str:
    return f"(lgamma({n}+1.0) - lgamma({k}+1.0) - lgamma({n}-({k})+1.0))"


def fisher2(a: str, b: str, c: str, d: str) -> str:
    """Two-sided Fisher p: sum over the support of the tables no likelier than the observed one."""
    n, good, draw = f"({a}+{b}+{c}+{d})", f"({a}+{c})", f"({a}+{b})"

    def lp(k):
        return f"({lchoose(good, k)} + {lchoose(f'({n}-{good})', f'({draw}-({k}))')} - {lchoose(n, draw)})"
    rng = f"range(greatest(0, {draw}+{good}-{n})::BIGINT, (least({good}, {draw})+1)::BIGINT)"
    return (f"least(1.0, list_sum(list_transform(list_filter({rng}, lambda zk: {lp('zk')} <= {lp(a)} + 1e-7), "
            f"lambda zk: exp({lp('zk')}))))")


def hyper_sf(k: str, m: str, good: str, draw: str) -> str:
    def lp(j):
        return f"({lchoose(good, j)} + {lchoose(f'({m}-{good})', f'({draw}-({j}))')} - {lchoose(m, draw)})"
    return f"least(1.0, coalesce(list_sum(list_transform(range(({k})::BIGINT, (least({good}, {draw})+1)::BIGINT), lambda zj: exp({lp('zj')}))), 0.0))"
