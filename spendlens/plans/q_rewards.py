"""Registered rewards queries (R1–R25, J6, J7, J9, F9, F11, F12) and their
oracles.  The oracles search portfolios by brute force: every client category
joined with every (portfolio, member card) from VALUES tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spendlens.operators import rewards as rw
from spendlens.operators.catalogue import (BEST_FOR, BRAND_RATES, CATALOGUE, CURRENT_BRAND_RULES,
                                           highlights, portfolios)
from spendlens.plans.registry import register
from spendlens.plans.sqlkit import MSD, R, categorized_cte, period_cte, q, with_ledger

DEC = "DECIMAL(6,4)"


def _values(name: str, cols: str, rows: list[tuple]) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return q(v)
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) t({cols}))"


PDIM = ("pdim AS (SELECT p.pid, COUNT(*) AS n_cards, string_agg(p.card, ', ' ORDER BY p.pos) "
        "AS optimal_cards, SUM(c.annual_fee) AS fees, SUM(c.signup_bonus) AS bonuses, "
        "arg_min(p.card, p.pos) AS primary_card FROM ports p JOIN cat_cards c ON p.card = c.card "
        "GROUP BY p.pid)")


def catalogue_ctes(cards=CATALOGUE, max_cards: int = 3) -> tuple[str, ...]:
    """``cat_cards``, ``cat_rates``, ``ports`` (every combination, in
    enumeration order) and ``pdim`` for a card list."""
    return (
        _values("cat_cards0", "card_ordinal, card, annual_fee, signup_bonus, default_rate, "
                "best_for", [(i, c.name, c.annual_fee, c.signup_bonus, str(c.default_rate),
                              BEST_FOR[c.name]) for i, c in enumerate(cards)]),
        f"cat_cards AS (SELECT card_ordinal, card, annual_fee, signup_bonus, "
        f"CAST(default_rate AS {DEC}) AS default_rate, best_for FROM cat_cards0)",
        _values("cat_rates0", "card, category, rate",
                [(c.name, k, str(r)) for c in cards for k, r in c.rates]),
        f"cat_rates AS (SELECT card, category, CAST(rate AS {DEC}) AS rate FROM cat_rates0)",
        _values("ports", "pid, card, pos",
                [(p.pid, cards[m].name, j) for p in portfolios(max_cards, cards)
                 for j, m in enumerate(p.members)]),
        PDIM,
    )


CATALOGUE_CTES = catalogue_ctes()


def spend_ctes(days: int = 365, mult: int = 1) -> tuple[str, ...]:
    """``cs(client_id, category, sp)`` annualised, ``cnt(client_id, transaction_count)``."""
    return (
        period_cte(days, name="pr", rule="spend"),
        "cnt AS (SELECT client_id, COUNT(*) AS transaction_count FROM pr GROUP BY client_id)",
        categorized_cte("pr", "prc"),
        f"cs AS (SELECT client_id, category, CAST({MSD('amount')} * {mult} AS DECIMAL(20,2)) AS sp "
        "FROM prc GROUP BY client_id, category)",
    )


OPT_CTES = (
    "pc AS (SELECT cs.client_id, p.pid, cs.category, cs.sp, "
    "MAX(COALESCE(r.rate, c.default_rate)) AS best FROM cs JOIN ports p ON TRUE "
    "JOIN cat_cards c ON c.card = p.card LEFT JOIN cat_rates r ON r.card = p.card "
    "AND r.category = cs.category GROUP BY cs.client_id, p.pid, cs.category, cs.sp)",
    "pn AS (SELECT pc.client_id, pc.pid, SUM(pc.sp * pc.best) - MAX(d.fees) AS net FROM pc "
    "JOIN pdim d ON d.pid = pc.pid GROUP BY pc.client_id, pc.pid)",
    "opt AS (SELECT client_id, pid, net FROM (SELECT *, row_number() OVER (PARTITION BY client_id "
    "ORDER BY net DESC, pid) AS rk FROM pn) WHERE rk = 1 AND net > 0)",
    "mr AS (SELECT cs.client_id, cs.category, cs.sp, p.card, p.pos, "
    "COALESCE(r.rate, c.default_rate) AS rate FROM cs JOIN opt o ON o.client_id = cs.client_id "
    "JOIN ports p ON p.pid = o.pid JOIN cat_cards c ON c.card = p.card "
    "LEFT JOIN cat_rates r ON r.card = p.card AND r.category = cs.category)",
    "fr AS (SELECT client_id, category, MAX(rate) AS best_rate, "
    "arg_max(card, struct_pack(r := rate, p := -pos)) AS best_card, "
    f"GREATEST(MAX(rate), CAST(0.01 AS {DEC})) AS floor_rate, "
    "CASE WHEN MAX(rate) > 0.01 THEN arg_max(card, struct_pack(r := rate, p := -pos)) "
    f"ELSE {q(rw.CURRENT_CARD)} END AS floor_card FROM mr GROUP BY client_id, category)",
)


def _current_ctes() -> tuple[str, ...]:
    cats: list[str] = []
    for _, cs, _ in CURRENT_BRAND_RULES:
        for c in cs:
            if c not in cats:
                cats.append(c)
    cols = []
    for i, c in enumerate(cats):
        whens = " ".join(f"WHEN lower(card_brand) LIKE '%{kw}%' THEN CAST({r} AS {DEC})"
                         for kw, cs, r in CURRENT_BRAND_RULES if c in cs)
        cols.append(f"MAX(CASE {whens} END) AS c{i}")
    rate = " ".join(f"WHEN cs.category = {q(c)} THEN GREATEST(CAST(0.01 AS {DEC}), "
                    f"COALESCE(k.c{i}, CAST(0.01 AS {DEC})))" for i, c in enumerate(cats))
    return (
        f"kr AS (SELECT client_id, {', '.join(cols)} FROM cards GROUP BY client_id)",
        f"crr AS (SELECT cs.client_id, cs.category, cs.sp, CASE {rate} ELSE CAST(0.01 AS {DEC}) "
        "END AS rate FROM cs LEFT JOIN kr k ON k.client_id = cs.client_id)",
        "curr AS (SELECT client_id, SUM(sp * rate) AS cur FROM crr GROUP BY client_id)",
    )


IMP_CTES = (
    "imp0 AS (SELECT o.client_id, o.pid AS portfolio_id, d.optimal_cards, "
    "CAST(cu.cur AS DOUBLE) AS current_annual_rewards, CAST(o.net AS DOUBLE) AS net_annual_rewards, "
    "CAST(d.fees AS DOUBLE) AS total_annual_fees, CAST(o.net - cu.cur AS DOUBLE) AS annual_improvement, "
    "CAST(d.bonuses AS BIGINT) AS signup_bonuses FROM opt o JOIN curr cu ON cu.client_id = o.client_id "
    "JOIN pdim d ON d.pid = o.pid)",
    "imp1 AS (SELECT *, CASE WHEN current_annual_rewards > 0 THEN annual_improvement / "
    "current_annual_rewards * 100 ELSE 0.0 END AS improvement_percentage, "
    "CASE WHEN annual_improvement <= 0 OR total_annual_fees = 0 THEN 0.0 "
    "ELSE total_annual_fees / annual_improvement END AS payback_period FROM imp0)",
    "imp AS (SELECT client_id, portfolio_id, optimal_cards, current_annual_rewards, "
    "net_annual_rewards, total_annual_fees, annual_improvement, improvement_percentage, "
    "signup_bonuses, payback_period, annual_improvement + signup_bonuses AS first_year_benefit, "
    "annual_improvement / 12 AS monthly_improvement, CASE WHEN total_annual_fees > 0 THEN "
    "annual_improvement / total_annual_fees * 100 ELSE 0.0 END AS efficiency_pct, "
    "CASE WHEN annual_improvement > 100 THEN 'excellent' WHEN annual_improvement > 50 THEN 'good' "
    "WHEN annual_improvement > 0 THEN 'minor' ELSE 'optimized' END AS improvement_band, "
    "CASE WHEN payback_period <= 0 THEN 'immediate' WHEN payback_period < 1 THEN 'under_one_year' "
    "WHEN payback_period < 2 THEN 'reasonable' ELSE 'long' END AS payback_band, "
    "CASE WHEN payback_period <= 0 THEN 'immediate' WHEN TRUNC(payback_period * 12) <= 6 THEN 'quick' "
    "WHEN TRUNC(payback_period * 12) <= 12 THEN 'reasonable' ELSE 'long' END AS payback_months_band, "
    "CAST(TRUNC(payback_period * 12) AS BIGINT) AS payback_months FROM imp1)",
)

def _rec_select(seq: int, value: str, where: str) -> str:
    prio, title, fmt, action = rw.RECOMMENDATIONS[seq - 1]
    rank = {"High": 1, "Medium": 2}.get(prio, 3)
    return (f"SELECT client_id, CAST({seq} AS BIGINT) AS seq, {q(prio)} AS priority, "
            f"CAST({rank} AS BIGINT) AS priority_rank, {q(title)} AS title, "
            f"printf({q(fmt)}, {value}) AS description, {q(action)} AS action FROM imp "
            f"WHERE {where}")


RECS_CTE = (
    "recs AS (" + " UNION ALL ".join([
        _rec_select(1, R("annual_improvement", 2), "annual_improvement > 100"),
        _rec_select(2, "CAST(signup_bonuses AS DOUBLE)", "signup_bonuses > 500"),
        _rec_select(3, R("payback_period", 1), "payback_period > 0 AND payback_period < 2"),
    ]) + ")",
)

CMP_CTES = (
    "cc0 AS (SELECT cs.client_id, c.card_ordinal, c.card, c.annual_fee, c.signup_bonus, c.best_for, "
    "SUM(cs.sp * COALESCE(r.rate, c.default_rate)) AS g FROM cs JOIN cat_cards c ON TRUE "
    "LEFT JOIN cat_rates r ON r.card = c.card AND r.category = cs.category "
    "GROUP BY cs.client_id, c.card_ordinal, c.card, c.annual_fee, c.signup_bonus, c.best_for)",
    "cc1 AS (SELECT *, g - annual_fee AS n, row_number() OVER (PARTITION BY client_id "
    "ORDER BY g - annual_fee DESC, card_ordinal) AS rk FROM cc0)",
    "mem AS (SELECT o.client_id, p.card FROM opt o JOIN ports p ON p.pid = o.pid)",
    "cmp AS (SELECT cc1.client_id, CAST(card_ordinal AS BIGINT) AS card_ordinal, cc1.card, "
    "CAST(annual_fee AS BIGINT) AS annual_fee, CAST(signup_bonus AS BIGINT) AS signup_bonus, best_for, "
    "CAST(g AS DOUBLE) AS gross_rewards, CAST(n AS DOUBLE) AS net_rewards, "
    "CAST(n + signup_bonus AS DOUBLE) AS first_year_value, CAST(rk AS BIGINT) AS rank, "
    "CASE WHEN annual_fee > 0 AND CAST(g AS DOUBLE) <> 0 THEN annual_fee / CAST(g AS DOUBLE) * 12 "
    "ELSE 0.0 END AS payback_months, CASE WHEN annual_fee > 0 THEN "
    "(CAST(n + signup_bonus AS DOUBLE) - annual_fee) / annual_fee * 100 ELSE 0.0 END AS roi_pct, "
    f"CASE WHEN annual_fee = 0 AND CAST(n AS DOUBLE) > 1000 THEN {q(rw.REASONS[0])} "
    f"WHEN annual_fee > 0 AND CAST(n AS DOUBLE) > 1500 THEN {q(rw.REASONS[1])} "
    f"WHEN contains(cc1.card, {q(rw.DOUBLE_CASH_MARK)}) THEN {q(rw.REASONS[2])} "
    f"ELSE {q(rw.REASONS[3])} END AS reason, rk <= 3 AS is_top3, "
    "mem.card IS NOT NULL AS in_optimal, n AS ndec FROM cc1 LEFT JOIN mem "
    "ON mem.client_id = cc1.client_id AND mem.card = cc1.card)",
)

N_BASE = ("N", *spend_ctes(), *CATALOGUE_CTES, *OPT_CTES)


def _n(*extra: str) -> str:
    return with_ledger(*N_BASE, *extra)


@register("annual_spending", "N", "R2, F9, F2, J1", with_ledger("N", *spend_ctes()) + (
    "SELECT cs.client_id, cs.category, CAST(cs.sp AS DOUBLE) AS annual_spending, "
    "CAST(SUM(cs.sp) OVER w AS DOUBLE) AS total_annual_spending, CAST(row_number() OVER "
    "(PARTITION BY cs.client_id ORDER BY cs.sp DESC, cs.category) AS BIGINT) AS spending_rank, "
    "row_number() OVER (PARTITION BY cs.client_id ORDER BY cs.sp DESC, cs.category) <= 5 AS in_top5, "
    "cnt.transaction_count FROM cs JOIN cnt ON cnt.client_id = cs.client_id "
    "WINDOW w AS (PARTITION BY cs.client_id)"))
def annual_spending(led):
    return rw.Rewards.of(led, "1_year").annual_spending().drop("_spend")


@register("current_rewards", "O", "R3, R4", with_ledger("O", *spend_ctes(), *_current_ctes(),
    "cardn AS (SELECT client_id, COUNT(*) AS card_count FROM cards GROUP BY client_id)") + (
    "SELECT crr.client_id, crr.category, CAST(crr.sp AS DOUBLE) AS annual_spending, "
    "CAST(crr.rate AS DOUBLE) AS current_rate, CAST(crr.sp * crr.rate AS DOUBLE) AS current_rewards, "
    "CAST(cu.cur AS DOUBLE) AS total_current_rewards, COALESCE(cardn.card_count, 0) AS card_count "
    "FROM crr JOIN curr cu ON cu.client_id = crr.client_id "
    "LEFT JOIN cardn ON cardn.client_id = crr.client_id"))
def current_rewards(led):
    from pyspark.sql import functions as F
    r = rw.Rewards.of(led, "1_year")
    cards = led.cards.groupBy("client_id").agg(F.count(F.lit(1)).alias("card_count"))
    return (r.current_rewards()
            .join(cards, "client_id", "left")
            .select("client_id", "category", "annual_spending", "current_rate", "current_rewards",
                    F.col("_cur_total").cast("double").alias("total_current_rewards"),
                    F.coalesce("card_count", F.lit(0).cast("long")).alias("card_count")))


_OPT_SELECT = (
    "SELECT o.client_id, CAST(o.pid AS INTEGER) AS portfolio_id, CAST(d.n_cards AS INTEGER) AS n_cards, "
    "d.optimal_cards, d.primary_card, CAST(o.net AS DOUBLE) AS net_annual_rewards, "
    "CAST(o.net + d.fees AS DOUBLE) AS gross_rewards, CAST(d.fees AS DOUBLE) AS total_annual_fees, "
    "CAST(d.bonuses AS BIGINT) AS signup_bonuses FROM opt o JOIN pdim d ON d.pid = o.pid")


@register("optimal_portfolio", "N", "R5, R6, J7", _n() + _OPT_SELECT)
def optimal_portfolio(led):
    return rw.Rewards.of(led, "1_year", 3).optimal().drop("_net", "member_cards")


_FEE_FREE = tuple(c for c in CATALOGUE if c.annual_fee == 0)


@register("optimal_portfolio_fee_free", "N", "R5 (include_annual_fees=False)",
          with_ledger("N", *spend_ctes(), *catalogue_ctes(_FEE_FREE), *OPT_CTES) + _OPT_SELECT)
def optimal_portfolio_fee_free(led):
    return rw.Rewards.of(led, "1_year", 3, include_annual_fees=False).optimal().drop(
        "_net", "member_cards")


@register("gross_by_category", "N", "R7, R18", _n() + (
    "SELECT fr.client_id, fr.category, CAST(cs.sp AS DOUBLE) AS annual_spending, fr.best_card, "
    "CAST(fr.best_rate AS DOUBLE) AS rate, CAST(cs.sp * fr.best_rate AS DOUBLE) AS optimal_rewards, "
    "CAST(cs.sp * CAST(0.01 AS DECIMAL(6,4)) AS DOUBLE) AS current_rewards FROM fr JOIN cs "
    "ON cs.client_id = fr.client_id AND cs.category = fr.category"))
def gross_by_category(led):
    return rw.Rewards.of(led, "1_year").gross_by_category()


@register("optimization_impact", "N", "R8, R9, R21, C24, C25, C26",
          _n(*_current_ctes(), *IMP_CTES) + "SELECT * FROM imp")
def optimization_impact(led):
    return rw.Rewards.of(led, "1_year").impact()


_BREAK_EVEN = ("CAST(c.annual_fee AS DOUBLE) / ((SUM(CAST(r.rate AS DOUBLE)) "
               "+ CAST(c.default_rate AS DOUBLE)) / (COUNT(r.rate) + 1))")


@register("break_even", "N", "R10", _n(
    "be AS (SELECT c.card, c.annual_fee, "
    f"{R(_BREAK_EVEN, 2)} AS break_even_spending FROM cat_cards c LEFT JOIN cat_rates r ON r.card = c.card "
    "WHERE c.annual_fee > 0 GROUP BY c.card, c.annual_fee, c.default_rate)") + (
    "SELECT o.client_id, p.card, CAST(be.annual_fee AS BIGINT) AS annual_fee, be.break_even_spending "
    "FROM opt o JOIN ports p ON p.pid = o.pid JOIN be ON be.card = p.card"))
def break_even(led):
    return rw.Rewards.of(led, "1_year").break_even()


@register("reward_recommendations", "N", "R11, F12",
          _n(*_current_ctes(), *IMP_CTES, *RECS_CTE) + "SELECT * FROM recs")
def reward_recommendations(led):
    return rw.Rewards.of(led, "1_year").recommendations()


@register("card_comparison", "N", "R12, R13, J9", _n(*CMP_CTES) + (
    "SELECT client_id, card_ordinal, card, annual_fee, signup_bonus, best_for, gross_rewards, "
    "net_rewards, first_year_value, rank, payback_months, roi_pct, reason, is_top3, in_optimal "
    "FROM cmp"))
def card_comparison(led):
    return rw.Rewards.of(led, "1_year").card_comparison().drop("_n")


_EXTRA_CTES = (
    "ce0 AS (SELECT cs.client_id, cs.category, cs.sp, "
    f"COALESCE(fr.floor_rate, CAST(0.01 AS {DEC})) AS rate, "
    f"COALESCE(fr.floor_card, {q(rw.CURRENT_CARD)}) AS best_card, COALESCE(d.primary_card, '') AS primary_card "
    "FROM cs LEFT JOIN opt o ON o.client_id = cs.client_id LEFT JOIN fr ON fr.client_id = cs.client_id "
    "AND fr.category = cs.category LEFT JOIN pdim d ON d.pid = o.pid)",
    f"ce1 AS (SELECT *, sp * CAST(0.01 AS {DEC}) AS cur, sp * rate AS pot, "
    f"sp * rate - sp * CAST(0.01 AS {DEC}) AS ad FROM ce0)",
    "ce2 AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY ad DESC, category) AS ork, "
    "row_number() OVER (PARTITION BY client_id, ad > 5 ORDER BY ad DESC, category) AS ark FROM ce1)",
    "ce3 AS (SELECT client_id, category, CAST(sp AS DOUBLE) AS annual_spending, best_card, "
    "primary_card, CAST(cur AS DOUBLE) AS current_rewards, CAST(pot AS DOUBLE) AS potential_rewards, "
    "CAST(ad AS DOUBLE) AS additional_rewards, CAST(rate AS DOUBLE) * 100 AS best_reward_rate, "
    "CASE WHEN cur > 0 THEN CAST(ad AS DOUBLE) / CAST(cur AS DOUBLE) * 100 ELSE 0.0 END "
    "AS improvement_pct, CAST(ork AS BIGINT) AS opportunity_rank, "
    "CAST(CASE WHEN ad > 5 AND ark <= 3 THEN ark ELSE 0 END AS BIGINT) AS action_priority, "
    "CAST(SUM(cur) OVER w AS DOUBLE) AS total_current, CAST(SUM(pot) OVER w AS DOUBLE) AS total_potential, "
    "CAST(SUM(ad) OVER w AS DOUBLE) AS total_additional, "
    "COALESCE(MAX(CASE WHEN ork = 1 AND ad > 0 THEN category END) OVER w, '') AS best_category, "
    "arg_min(category, struct_pack(a := -sp, b := category)) OVER w AS top_spend_category, "
    f"{R('quantile_cont(CAST(sp AS DOUBLE), 0.5) OVER w', 6)} AS median_spending, "
    f"{R('quantile_cont(CAST(ad AS DOUBLE), 0.5) OVER w', 6)} AS median_additional "
    "FROM ce2 WINDOW w AS (PARTITION BY client_id))",
)


@register("category_extra_rewards", "N", "R14, R15, R16, R17, F11", _n(*_EXTRA_CTES) + (
    "SELECT *, CASE WHEN total_current > 0 THEN total_additional / total_current * 100 ELSE 0.0 END "
    f"AS uplift_pct, CASE WHEN action_priority > 0 THEN printf({q(rw.ACTION_TEXT)}, category, "
    f"best_card) ELSE '' END AS action, "
    "CASE WHEN action_priority > 0 THEN additional_rewards / 12 "
    "ELSE 0.0 END AS monthly_impact FROM ce3"))
def category_extra_rewards(led):
    return rw.Rewards.of(led, "1_year").category_extra_rewards()


@register("coverage_and_advantage", "N", "R19, R20, F11", _n(
    *CMP_CTES,
    "cov AS (SELECT fr.client_id, CASE WHEN SUM(cs.sp) > 0 THEN CAST(COALESCE(SUM(CASE WHEN "
    "fr.floor_rate > 0.015 THEN cs.sp END), 0) AS DOUBLE) / CAST(SUM(cs.sp) AS DOUBLE) * 100 "
    "ELSE 0.0 END AS coverage_pct FROM fr JOIN cs ON cs.client_id = fr.client_id "
    "AND cs.category = fr.category GROUP BY fr.client_id)") + (
    "SELECT o.client_id, d.optimal_cards, cov.coverage_pct, cmp.card AS best_single_card, "
    "cmp.net_rewards AS best_single_net, CAST(o.net AS DOUBLE) AS portfolio_net, "
    "o.net > cmp.ndec AS portfolio_better, CASE WHEN o.net > cmp.ndec THEN "
    "CAST(o.net - cmp.ndec AS DOUBLE) ELSE 0.0 END AS portfolio_advantage FROM opt o "
    "JOIN pdim d ON d.pid = o.pid JOIN cov ON cov.client_id = o.client_id "
    "JOIN cmp ON cmp.client_id = o.client_id AND cmp.rank = 1"))
def coverage_and_advantage(led):
    return rw.Rewards.of(led, "1_year").coverage_and_advantage()


@register("five_year_projection", "N", "R22", _n(*_current_ctes()) + (
    "SELECT o.client_id, CAST(y.year AS BIGINT) AS year, CAST(cu.cur * y.year AS DOUBLE) "
    "AS current_cumulative, CAST(o.net * y.year + CASE WHEN y.year = 1 THEN d.bonuses ELSE 0 END "
    "AS DOUBLE) AS optimal_cumulative, CAST(o.net * y.year + CASE WHEN y.year = 1 THEN d.bonuses "
    "ELSE 0 END - cu.cur * y.year AS DOUBLE) AS difference FROM opt o JOIN curr cu "
    "ON cu.client_id = o.client_id JOIN pdim d ON d.pid = o.pid "
    "JOIN (SELECT range AS year FROM range(1, 6)) y ON TRUE"))
def five_year_projection(led):
    return rw.Rewards.of(led, "1_year").five_year_projection()


_HL = _values("hl", "best_card, card_best_for, card_high_rates",
              [(c.name, *highlights(c)) for c in CATALOGUE])


@register("card_usage_plan", "N", "R23, R24, F11", _n(_HL) + (
    "SELECT fr.client_id, fr.category, CAST(cs.sp AS DOUBLE) AS annual_spending, fr.best_card, "
    "CAST(fr.best_rate AS DOUBLE) * 100 AS reward_rate_pct, hl.card_best_for, hl.card_high_rates "
    "FROM fr JOIN cs ON cs.client_id = fr.client_id AND cs.category = fr.category "
    "LEFT JOIN hl ON hl.best_card = fr.best_card WHERE cs.sp > 100"))
def card_usage_plan(led):
    return rw.Rewards.of(led, "1_year").card_usage_plan()


@register("portfolio_cards", "N", "R24, F11", _n(_HL) + (
    "SELECT o.client_id, CAST(p.pos + 1 AS BIGINT) AS position, p.card, CAST(c.annual_fee AS BIGINT) AS annual_fee, "
    "CAST(c.signup_bonus AS BIGINT) AS signup_bonus, hl.card_best_for AS best_for, hl.card_high_rates AS high_rates, "
    "(SELECT string_agg(r.category || ' ' || CAST(r.rate AS VARCHAR), '; ' ORDER BY r.rate DESC, r.category) "
    "FROM cat_rates r WHERE r.card = p.card) AS rates FROM opt o JOIN ports p ON p.pid = o.pid "
    "JOIN cat_cards c ON c.card = p.card LEFT JOIN hl ON hl.best_card = p.card"))
def portfolio_cards(led):
    df = rw.Rewards.of(led, "1_year").portfolio_cards()
    text = F.transform("rates", lambda r: F.concat(r["category"], F.lit(" "), r["rate"].cast("string")))
    return df.withColumn("rates", F.when(F.size("rates") > 0, F.array_join(text, "; ")))


def _list_json(fields: dict[str, str], order: str) -> str:
    packed = ", ".join(f"{k} := {v}" for k, v in fields.items())
    return f"CAST(to_json(list(struct_pack({packed}) ORDER BY {order})) AS VARCHAR)"


_BUNDLE_PARTS = (
    "b_cards AS (SELECT client_id, " + _list_json({
        "card_id": "id", "card_brand": "card_brand", "card_type": "card_type", "credit_limit": "credit_limit"}, "id")
    + " AS current_cards FROM cards GROUP BY client_id)",
    "b_rank AS (SELECT client_id, category, CAST(sp AS DOUBLE) AS annual_spending, row_number() OVER "
    "(PARTITION BY client_id ORDER BY sp DESC, category) AS rank FROM cs)",
    "b_top AS (SELECT client_id, " + _list_json({
        "rank": "rank", "category": "category", "annual_spending": "CAST(CAST(annual_spending AS DECIMAL(20,2)) AS VARCHAR)"}, "rank")
    + " AS top_categories FROM b_rank WHERE rank <= 5 GROUP BY client_id)",
    "b_details AS (SELECT o.client_id, " + _list_json({
        "position": "p.pos + 1", "card": "p.card", "annual_fee": "c.annual_fee", "signup_bonus": "c.signup_bonus",
        "best_for": "hl.card_best_for"}, "p.pos")
    + " AS card_details FROM opt o JOIN ports p ON p.pid = o.pid JOIN cat_cards c ON c.card = p.card "
    "LEFT JOIN hl ON hl.best_card = p.card GROUP BY o.client_id)",
    "b_recs AS (SELECT client_id, " + _list_json({
        k: k for k in ("priority_rank", "seq", "priority", "title", "description", "action")}, "priority_rank, seq")
    + " AS recommendations FROM recs GROUP BY client_id)",
)


@register("portfolio_bundle", "N", "R25", _n(
    *_current_ctes(), *IMP_CTES, *RECS_CTE, _HL, *_BUNDLE_PARTS,
    "rc AS (SELECT client_id, COUNT(*) AS recommendation_count FROM recs GROUP BY client_id)",
    "tot AS (SELECT client_id, CAST(SUM(sp) AS DOUBLE) AS total_annual_spending FROM cs "
    "GROUP BY client_id)") + (
    "SELECT tot.client_id, tot.total_annual_spending, cnt.transaction_count, "
    "CAST(cu.cur AS DOUBLE) AS current_annual_rewards, imp.optimal_cards IS NOT NULL AS has_optimal, "
    "COALESCE(imp.optimal_cards, '') AS optimal_cards, COALESCE(imp.net_annual_rewards, 0.0) "
    "AS net_annual_rewards, COALESCE(imp.annual_improvement, 0.0) AS annual_improvement, "
    "COALESCE(imp.signup_bonuses, 0) AS signup_bonuses, COALESCE(imp.first_year_benefit, 0.0) "
    "AS first_year_benefit, COALESCE(imp.payback_period, 0.0) AS payback_period, "
    "COALESCE(rc.recommendation_count, 0) AS recommendation_count, "
    "COALESCE(b_cards.current_cards, '[]') AS current_cards, COALESCE(b_top.top_categories, '[]') AS top_categories, "
    "COALESCE(b_details.card_details, '[]') AS card_details, COALESCE(b_recs.recommendations, '[]') AS recommendations FROM tot "
    "JOIN cnt ON cnt.client_id = tot.client_id JOIN curr cu ON cu.client_id = tot.client_id "
    "LEFT JOIN imp ON imp.client_id = tot.client_id LEFT JOIN rc ON rc.client_id = tot.client_id "
    "LEFT JOIN b_cards ON b_cards.client_id = tot.client_id LEFT JOIN b_top ON b_top.client_id = tot.client_id "
    "LEFT JOIN b_details ON b_details.client_id = tot.client_id LEFT JOIN b_recs ON b_recs.client_id = tot.client_id"))
def portfolio_bundle(led):
    df = rw.Rewards.of(led, "1_year").bundle()
    # Amounts as decimal text: the engines write large doubles differently.
    top = F.transform("top_categories", lambda r: F.struct(
        r["rank"].alias("rank"), r["category"].alias("category"),
        r["annual_spending"].cast("decimal(20,2)").cast("string").alias("annual_spending")))
    df = df.withColumn("top_categories", top)
    parts = ("current_cards", "top_categories", "card_details", "recommendations")
    return df.select(*[F.to_json(c, {"ignoreNullFields": "false"}).alias(c) if c in parts else c for c in df.columns])


@register("catalogue_rates", "N", "R1", with_ledger(
    "N", *spend_ctes(), *CATALOGUE_CTES) + (
    "SELECT cs.client_id, cs.category, CAST(cs.sp AS DOUBLE) AS annual_spending, "
    "CAST(c.card_ordinal AS BIGINT) AS card_ordinal, c.card, "
    "CAST(COALESCE(r.rate, c.default_rate) AS DOUBLE) AS rate, CAST(c.annual_fee AS BIGINT) AS annual_fee, "
    "CAST(c.signup_bonus AS BIGINT) AS signup_bonus FROM cs JOIN cat_cards c ON TRUE "
    "LEFT JOIN cat_rates r ON r.card = c.card AND r.category = cs.category"))
def catalogue_rates(led):
    return rw.Rewards.of(led, "1_year").catalogue_rates()


_BRAND_RATES = _values("br0", "brand, category, rate",
                       [(b, k, str(v)) for b, (rates, _) in BRAND_RATES.items()
                        for k, v in rates.items()])
_BRAND_DEF = _values("bd0", "brand, rate", [(b, str(d)) for b, (_, d) in BRAND_RATES.items()])


@register("owned_card_rewards", "O", "J6, R14", with_ledger(
    "O", period_cte(90), categorized_cte("f", "fc"),
    f"cso AS (SELECT client_id, category, CAST({MSD('amount')} AS DECIMAL(20,2)) AS sp FROM fc "
    "GROUP BY client_id, category)",
    _BRAND_RATES, _BRAND_DEF,
    "oc AS (SELECT cso.client_id, cso.category, cso.sp, cd.id AS card_id, "
    "cd.card_brand || ' (' || cd.card_type || ')' AS label, "
    f"CAST(COALESCE(br0.rate, bd0.rate) AS {DEC}) AS rate FROM cso JOIN cards cd "
    "ON cd.client_id = cso.client_id LEFT JOIN bd0 ON bd0.brand = cd.card_brand "
    "LEFT JOIN br0 ON br0.brand = cd.card_brand AND br0.category = cso.category)",
    f"og AS (SELECT client_id, category, sp, COALESCE(MAX(rate), CAST(0 AS {DEC})) AS best, "
    "arg_min(label, struct_pack(a := -rate, b := card_id)) FILTER (WHERE rate IS NOT NULL) AS card "
    "FROM oc GROUP BY client_id, category, sp)") + (
    "SELECT client_id, category, CAST(sp AS DOUBLE) AS spending, "
    f"CAST(sp * CAST(0.01 AS {DEC}) AS DOUBLE) AS current_rewards, CAST(sp * best AS DOUBLE) "
    f"AS potential_rewards, CAST(sp * best - sp * CAST(0.01 AS {DEC}) AS DOUBLE) AS additional_rewards, "
    f"COALESCE(card, {q(rw.CURRENT_CARD)}) AS best_card, CAST(best AS DOUBLE) * 100 AS best_reward_rate, "
    f"CASE WHEN sp * CAST(0.01 AS {DEC}) > 0 THEN CAST(sp * best - sp * CAST(0.01 AS {DEC}) AS DOUBLE) "
    f"/ CAST(sp * CAST(0.01 AS {DEC}) AS DOUBLE) * 100 ELSE 0.0 END AS improvement_pct FROM og"))
def owned_card_rewards(led):
    return rw.owned_card_rewards(led, "3_months")


# ---- parameter variants ------------------------------------------------------

@register("annual_spending_quarterly", "N", "R2, F9 (3 months × 4)", with_ledger(
    "N", *spend_ctes(90, 4)) + (
    "SELECT cs.client_id, cs.category, CAST(cs.sp AS DOUBLE) AS annual_spending, "
    "CAST(SUM(cs.sp) OVER w AS DOUBLE) AS total_annual_spending, CAST(row_number() OVER "
    "(PARTITION BY cs.client_id ORDER BY cs.sp DESC, cs.category) AS BIGINT) AS spending_rank, "
    "row_number() OVER (PARTITION BY cs.client_id ORDER BY cs.sp DESC, cs.category) <= 5 AS in_top5, "
    "cnt.transaction_count FROM cs JOIN cnt ON cnt.client_id = cs.client_id "
    "WINDOW w AS (PARTITION BY cs.client_id)"))
def annual_spending_quarterly(led):
    return rw.Rewards.of(led, "3_months").annual_spending().drop("_spend")


@register("optimal_portfolio_5_cards", "N", "R5, R6 (max_cards = 5)",
          with_ledger("N", *spend_ctes(), *catalogue_ctes(CATALOGUE, 5), *OPT_CTES) + _OPT_SELECT)
def optimal_portfolio_5_cards(led):
    return rw.Rewards.of(led, "1_year", 5).optimal().drop("_net", "member_cards")
