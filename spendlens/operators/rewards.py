"""Rewards optimisation (R2–R25, J6, J7, J9), for all clients at once.

Plan shape: the period's purchases are aggregated once per client × mcc and
then per client × category (R2), then folded per client into a short vector
of spend per *rate key* (the categories some card rates specially, plus one
bucket for all the rest).  The candidate portfolios are a constant array of
integer rate vectors; one lambda scores each as an exact integer dot product
(cents × rate in 1/10,000, minus fees) and ``array_max`` picks the best, so
the portfolio search is a projection of one row per client: no cross join,
no per-portfolio fan-out, exact comparison (ties go to the earlier
combination, i.e. fewer cards, then catalogue order).  The per-client views
(impact, recommendations, projection, coverage, bundle) are projections of
that same summary row; only per-category views join back to the categories.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions.categories import with_category
from spendlens.functions.exprs import (card_label, cents, cents_to_dec, improvement_band,
                                       money_sum_dec, payback_band, payback_months,
                                       payback_months_band, round_dec)
from spendlens.functions.periods import period_days, recent, reward_period, spend_only
from spendlens.operators.catalogue import (BEST_FOR, BRAND_RATES, CATALOGUE, CURRENT_BASE_RATE,
                                           CURRENT_BRAND_RULES, OTHER_KEY, Card, break_even,
                                           highlights, portfolios, rate_keys, undominated)
from spendlens.plans.joins import attach_per_client
from spendlens.session import app_id
from spendlens.sources.loaders import current_portfolio
from spendlens.sources.schema import Ledger

RATE_T = T.DecimalType(6, 4)
SPEND_T = "decimal(20,2)"
NET_T = "decimal(30,6)"
BASE = Decimal("0.01")
COVERAGE_RATE = Decimal("0.015")
ACTION_MIN_EXTRA = 5
# Card combinations in one constant array; more are scored in several arrays.
PORTFOLIO_CHUNK = 512

# The name shown when no card beats 1 %; the three recommendation
# rules' (priority, title, description format, action); the comparison
# table's reason labels (the third applies to a card named with "Double
# Cash"); the action-plan wording around the category and the card.
CURRENT_CARD = "Current Card"
RECOMMENDATIONS = (
    ("High", "Significant Rewards Opportunity",
     "Optimizing your card portfolio could earn you $%.2f more per year.",
     "Consider applying for recommended cards"),
    ("High", "Valuable Signup Bonuses Available",
     "You could earn $%.2f in signup bonuses.",
     "Apply for cards with highest signup bonuses first"),
    ("Medium", "Fast Payback Period",
     "Annual fees will pay for themselves in %.1f years.",
     "Annual fees are justified by rewards earned"),
)
REASONS = ("High value with no annual fee", "High rewards justify the annual fee",
           "Simple 2% on everything", "Strong overall performance")
DOUBLE_CASH_MARK = "Double Cash"
ACTION_TEXT = "Switch %s spending to %s"


def _r(x: Decimal) -> Column:
    return F.lit(x).cast(RATE_T)


def _key_of(category: Column, keys: list[str]) -> Column:
    return F.when(category.isin(*keys), category).otherwise(F.lit(OTHER_KEY))


def _sql(v) -> str:
    """A Python constant as Spark SQL literal text (for constant arrays built
    in one expression instead of one JVM call per element)."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, Decimal):
        return f"CAST('{v}' AS DECIMAL(6,4))"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(_sql(x) for x in v) + ")"
    raise TypeError(type(v))


_PARTS = ("current_cards", "top_categories", "card_details", "recommendations")
_DIMS: dict[tuple, DataFrame] = {}


def _cached_dim(spark, key: tuple, build) -> DataFrame:
    """Small catalogue-derived frames, built once per application."""
    k = (app_id(spark), *key)
    if k not in _DIMS:
        _DIMS[k] = build()
    return _DIMS[k]


class Rewards:
    """All rewards analyses of one ledger for one period and portfolio size.

    ``period`` follows F9 (anchor after F2; 90 d ×4, 180 d ×2, else 365 d ×1);
    ``max_cards`` bounds the portfolio size (1–5 in the dashboard);
    ``include_annual_fees=False`` keeps only the catalogue's fee-free cards
    (the dashboard's "include cards with annual fees" option).
    """

    @classmethod
    def of(cls, ledger: Ledger, period: str = "1_year", max_cards: int = 3,
           catalogue: tuple[Card, ...] = CATALOGUE,
           include_annual_fees: bool = True) -> "Rewards":
        """The ledger's shared analysis for these parameters."""
        return ledger.memo(("rewards", period, max_cards, tuple(catalogue), include_annual_fees),
                           lambda: cls(ledger, period, max_cards, catalogue,
                                       include_annual_fees))

    def __init__(self, ledger: Ledger, period: str = "1_year", max_cards: int = 3,
                 catalogue: tuple[Card, ...] = CATALOGUE, include_annual_fees: bool = True):
        if not include_annual_fees:
            catalogue = tuple(c for c in catalogue if c.annual_fee == 0)
        if not catalogue:
            raise ValueError("empty card catalogue")
        self.ledger = ledger
        self.period = period
        self.catalogue = catalogue
        self.keys = rate_keys(catalogue)
        self.max_cards = max_cards
        self.ports = undominated(portfolios(max_cards, catalogue), self.keys, catalogue)
        self.spark = ledger.spark

    # ---- spending ------------------------------------------------------
    def period_rows(self) -> DataFrame:
        days, _ = reward_period(self.period)
        return spend_only(recent(self.ledger, days, "spend", ("client_id", "mcc", "amount", "date")))

    def annual_spending(self) -> DataFrame:
        """R2: annualised spend per client × category, its rank, the client's
        total and the number of purchases in the period.

        Two-level aggregation: per client × mcc first (map-side combined;
        also yields the purchase count before any category fan-out), then the
        small MCC dimension is joined and folded per client × category."""
        if getattr(self, "_sp", None) is None:
            # Purchases by mcc, each once however many categories an mcc has:
            # an array no longer than the list of mccs.
            every = F.array_distinct(F.flatten(F.collect_list("_mn").over(Window.partitionBy("client_id"))))
            count = F.aggregate(every, F.lit(0).cast("long"), lambda n, x: n + x["_n"])
            self._sp = self._category_rows().withColumn("transaction_count", count).drop("_mn")
        return self._sp

    def _by_mcc(self) -> DataFrame:
        if getattr(self, "_bm", None) is None:
            self._bm = self.period_rows().groupBy("client_id", "mcc").agg(
                F.sum(cents("amount")).alias("_m"), F.count(F.lit(1)).alias("_n"))
        return self._bm

    def transaction_counts(self) -> DataFrame:
        """Purchases in the period per client (before any category fan-out);
        joined only by the outputs that show it."""
        return self._by_mcc().groupBy("client_id").agg(
            F.sum("_n").alias("transaction_count"))

    def category_spend(self) -> DataFrame:
        """R2 without the purchase count: what every other analysis starts from."""
        if getattr(self, "_cs", None) is None:
            self._cs = self._category_rows().drop("_mn")
        return self._cs

    def _category_rows(self) -> DataFrame:
        _, mult = reward_period(self.period)
        g = (with_category(self._by_mcc(), self.ledger.mcc_codes, fallback="rewards")
             .groupBy("client_id", "category")
             .agg(cents_to_dec(F.sum("_m") * F.lit(mult), 20).alias("_spend"),
                  F.collect_set(F.struct("mcc", "_n")).alias("_mn")))
        w = Window.partitionBy("client_id")
        rk = F.row_number().over(w.orderBy(F.col("_spend").desc(), F.col("category")))
        g = g.select("client_id", "category", "_spend", "_mn",
                     F.col("_spend").cast("double").alias("annual_spending"),
                     F.sum("_spend").over(w).cast("double").alias("total_annual_spending"),
                     rk.cast("long").alias("spending_rank"))
        return g.withColumn("in_top5", F.col("spending_rank") <= 5)

    def key_spend(self, spending: DataFrame | None = None) -> DataFrame:
        """One row per client: spend per rate key (``_k0``…) and for all other
        categories (``_ko``)."""
        if spending is None and getattr(self, "_ks", None) is not None:
            return self._ks
        sp = self.category_spend() if spending is None else spending
        cat = F.col("category")
        aggs = [F.coalesce(F.sum(F.when(cat == k, F.col("_spend"))), F.lit(0).cast(SPEND_T))
                .cast(SPEND_T).alias(f"_k{i}") for i, k in enumerate(self.keys)]
        aggs.append(F.coalesce(F.sum(F.when(~cat.isin(*self.keys), F.col("_spend"))),
                               F.lit(0).cast(SPEND_T)).cast(SPEND_T).alias("_ko"))
        aggs.append(F.sum("_spend").alias("_total"))
        ks = sp.groupBy("client_id").agg(*aggs)
        if spending is None:
            self._ks = ks
        return ks

    def _dot(self, rate_of) -> Column:
        """Σ spend_k × rate(k) over the key vector; ``rate_of(None)`` is the
        rate of unlisted categories."""
        terms = [f"_k{i} * {_sql(Decimal(rate_of(k)))}" for i, k in enumerate(self.keys)]
        terms.append(f"_ko * {_sql(Decimal(rate_of(None)))}")
        return F.expr(f"CAST({' + '.join(terms)} AS {NET_T})")

    # ---- dimensions ----------------------------------------------------
    def portfolio_key_dim(self) -> DataFrame:
        """Per portfolio × rate key: best member rate from 0 (R7) and from the
        1 % floor (R14, ``Current Card`` when no member beats it)."""
        key = ("pk", self.max_cards, tuple(self.catalogue))
        return _cached_dim(self.spark, key, self._portfolio_key_dim)

    def _portfolio_key_dim(self) -> DataFrame:
        rows = []
        for p in self.ports:
            for k in [*self.keys, OTHER_KEY]:
                cat = None if k == OTHER_KEY else k
                r, c = p.best(cat, catalogue=self.catalogue)
                fr, fc = p.best(cat, BASE, CURRENT_CARD, self.catalogue)
                rows.append((p.pid, k, r, c, fr, fc))
        schema = T.StructType([
            T.StructField("portfolio_id", T.IntegerType()),
            T.StructField("rate_key", T.StringType()),
            T.StructField("best_rate", RATE_T), T.StructField("best_card", T.StringType()),
            T.StructField("floor_rate", RATE_T), T.StructField("floor_card", T.StringType())])
        return self.spark.createDataFrame(rows, schema)

    # ---- R4: current cards ---------------------------------------------
    def current_card_rates(self) -> DataFrame:
        """Per client, the best rule rate of its current cards for each rule
        category (rules are tried per card in order; first match wins)."""
        brand = F.lower(F.coalesce(F.col("card_brand"), F.lit("")))
        cats = []
        for _, cs, _ in CURRENT_BRAND_RULES:
            for c in cs:
                if c not in cats:
                    cats.append(c)
        aggs = []
        for i, c in enumerate(cats):
            e = F.lit(None).cast(RATE_T)
            for kw, cs, rate in reversed(CURRENT_BRAND_RULES):
                if c in cs:
                    e = F.when(brand.contains(kw), _r(rate)).otherwise(e)
            aggs.append(F.max(e).alias(f"_c{i}"))
        self._rule_cats = cats
        return self.ledger.cards.groupBy("client_id").agg(*aggs)

    def current_rewards(self, spending: DataFrame | None = None) -> DataFrame:
        """Per client × category, the current rate (1 % unless a current
        card's brand rule pays more) and rewards; no annual fees."""
        if spending is None and getattr(self, "_cr", None) is not None:
            return self._cr
        sp = self.category_spend() if spending is None else spending
        rates = self.current_card_rates()
        df = attach_per_client(self.ledger, sp, rates, "left")
        rate = _r(CURRENT_BASE_RATE)
        for i, c in enumerate(self._rule_cats):
            rate = F.when(F.col("category") == c,
                          F.greatest(_r(CURRENT_BASE_RATE), F.coalesce(F.col(f"_c{i}"),
                                                                       _r(CURRENT_BASE_RATE))))\
                .otherwise(rate)
        df = df.withColumn("_rate", rate)
        w = Window.partitionBy("client_id")
        cur = (F.col("_spend") * F.col("_rate")).cast(NET_T)
        out = df.select(
            "client_id", "category", "_spend", "annual_spending",
            F.col("_rate").cast("double").alias("current_rate"),
            cur.alias("_cur"), cur.cast("double").alias("current_rewards"),
            F.sum(cur).over(w).alias("_cur_total"))
        if spending is None:
            self._cr = out
        return out

    # ---- per-client summary ----------------------------------------------
    def _by_pid(self, values: list, pid: str = "_place") -> Column:
        """Look an attribute up in a constant array indexed by place."""
        return F.expr(f"element_at({_sql(list(values))}, {pid} + 1)")

    def _argmax(self, vectors: list[tuple[int, int, list[int]]]) -> Column:
        """Best candidate by integer net reward (micro-units): spend in cents
        × rate in 1/10,000 minus fee; ties go to the lower ordinal.  The
        candidates are constant arrays scored by one lambda each, so their
        number adds little generated code."""
        if len(vectors) > PORTFOLIO_CHUNK:
            return F.greatest(*[self._argmax(vectors[i:i + PORTFOLIO_CHUNK])
                                for i in range(0, len(vectors), PORTFOLIO_CHUNK)])
        cand = "array(" + ", ".join(
            f"named_struct('o', {o}, 'fee', CAST({fee} AS BIGINT), "
            + ", ".join(f"'r{j}', {_sql(r)}" for j, r in enumerate(rates)) + ")"
            for o, fee, rates in vectors) + ")"
        cents = [f"CAST(_k{i} * 100 AS BIGINT)" for i in range(len(self.keys))]
        cents.append("CAST(_ko * 100 AS BIGINT)")
        score = " + ".join(f"{c} * p.r{j}" for j, c in enumerate(cents))
        return F.expr(f"array_max(transform({cand}, p -> named_struct("
                      f"'net', {score} - p.fee, 'neg', -p.o, 'o', p.o)))")

    @staticmethod
    def _from_micros(c: Column) -> Column:
        return (c.cast("decimal(30,0)") * F.lit(Decimal("0.000001")).cast("decimal(7,6)")
                ).cast(NET_T)

    def summary(self) -> DataFrame:
        """One row per client with spending: the spend vector, the current
        cards' annual rewards (R4), the best portfolio (R5–R6) with its
        attributes, the share of spend it rates above 1.5 % (R19) and the
        best single catalogue card (R12 rank 1).  Every per-client analysis
        is a projection of this row."""
        if getattr(self, "_sum", None) is not None:
            return self._sum
        ks = self.key_spend()
        rates = self.current_card_rates()
        df = attach_per_client(self.ledger, ks, rates, "left")
        base = _r(CURRENT_BASE_RATE)
        rule = {c: j for j, c in enumerate(self._rule_cats)}
        cur = F.col("_ko") * base
        for i, k in enumerate(self.keys):
            rate = (F.greatest(base, F.coalesce(F.col(f"_c{rule[k]}"), base)) if k in rule
                    else base)
            cur = cur + F.col(f"_k{i}") * rate
        keys = [*self.keys, None]
        ports = [(i, p.fees(self.catalogue) * 1_000_000,
                  [int(p.best(k, catalogue=self.catalogue)[0] * 10000) for k in keys])
                 for i, p in enumerate(self.ports)]
        singles = [(i, c.annual_fee * 1_000_000,
                    [int((c.default_rate if k is None else c.rate(k)) * 10000) for k in keys])
                   for i, c in enumerate(self.catalogue)]
        df = df.select("*", cur.cast(NET_T).alias("_cur_total"),
                       self._argmax(ports).alias("_bp"), self._argmax(singles).alias("_bs"))
        df = df.select(
            "*", F.col("_bp.o").alias("_place"), self._by_pid([p.pid for p in self.ports], "_bp.o")
            .alias("portfolio_id"), self._from_micros(F.col("_bp.net")).alias("_net"), (F.col("_bp.net") > 0).alias("has_optimal"),
            F.col("_bs.o").alias("_single_ord"), self._from_micros(F.col("_bs.net"))
            .alias("_single_net"))
        cards = [p.cards(self.catalogue) for p in self.ports]
        covered = F.lit(0).cast(SPEND_T)
        for i, k in enumerate(keys):
            flags = [p.best(k, BASE, CURRENT_CARD, self.catalogue)[0] > COVERAGE_RATE
                     for p in self.ports]
            spend = F.col(f"_k{i}") if k is not None else F.col("_ko")
            covered = covered + F.when(self._by_pid(flags), spend).otherwise(F.lit(0))
        self._sum = df.select(
            "*",
            self._by_pid([len(c) for c in cards]).alias("n_cards"),
            self._by_pid([", ".join(x.name for x in c) for c in cards]).alias("optimal_cards"),
            self._by_pid([[x.name for x in c] for c in cards]).alias("member_cards"),
            self._by_pid([c[0].name for c in cards]).alias("primary_card"),
            self._by_pid([p.fees(self.catalogue) for p in self.ports]).alias("total_annual_fees"),
            self._by_pid([p.bonuses(self.catalogue) for p in self.ports]).alias("signup_bonuses"),
            covered.alias("_covered"),
            self._by_pid([c.name for c in self.catalogue], "_single_ord")
            .alias("best_single_card"))
        return self._sum

    # ---- R5–R6: optimal portfolio ---------------------------------------
    def optimal(self) -> DataFrame:
        """R5 + R6: per client the combination with the highest net reward
        (strictly positive), as ``portfolio_id`` plus its figures."""
        s = self.summary().filter(F.col("has_optimal"))
        gross = (F.col("_net") + F.col("total_annual_fees")).cast(NET_T)
        return s.select(
            "client_id", "portfolio_id", "n_cards", "optimal_cards", "member_cards",
            "primary_card", "_net", F.col("_net").cast("double").alias("net_annual_rewards"),
            gross.cast("double").alias("gross_rewards"),
            F.col("total_annual_fees").cast("double").alias("total_annual_fees"),
            F.col("signup_bonuses").cast("long").alias("signup_bonuses"))

    # ---- R7 + R18 -------------------------------------------------------
    def _with_portfolio_rates(self, sp: DataFrame, opt: DataFrame, how: str) -> DataFrame:
        df = attach_per_client(self.ledger, sp, opt.select("client_id", "portfolio_id"), how)
        df = df.withColumn("rate_key", _key_of(F.col("category"), self.keys))
        return df.join(self.portfolio_key_dim(), ["portfolio_id", "rate_key"],
                       "left")

    def gross_by_category(self) -> DataFrame:
        """R7 + R18: for clients with an optimal portfolio, per category the
        winning card (first member with the highest rate), its rate and the
        rewards, next to the 1 % baseline."""
        sp = self.category_spend()
        df = self._with_portfolio_rates(sp, self.optimal(), "inner")
        rew = (F.col("_spend") * F.col("best_rate")).cast(NET_T)
        return df.select(
            "client_id", "category", "annual_spending", "best_card",
            F.col("best_rate").cast("double").alias("rate"),
            rew.cast("double").alias("optimal_rewards"),
            (F.col("_spend") * _r(BASE)).cast("double").alias("current_rewards"))

    # ---- R8, R9, R21 ----------------------------------------------------
    @staticmethod
    def _impact_cols(df: DataFrame) -> DataFrame:
        """Impact figures (R8, R9, R21, C24–C26) as columns of summary rows."""
        imp_dec = (F.col("_net") - F.col("_cur_total")).cast(NET_T)
        df = df.select("*", imp_dec.cast("double").alias("annual_improvement"),
                       F.col("_cur_total").cast("double").alias("current_annual_rewards"),
                       F.col("_net").cast("double").alias("net_annual_rewards"),
                       F.col("total_annual_fees").cast("double").alias("_fees"))
        imp = F.col("annual_improvement")
        cur_d = F.col("current_annual_rewards")
        fees = F.col("_fees")
        payback = F.when((imp <= 0) | (fees == 0), F.lit(0.0)).otherwise(fees / imp)
        return df.select(
            "*",
            F.when(cur_d > 0, imp / cur_d * 100).otherwise(F.lit(0.0))
            .alias("improvement_percentage"),
            payback.alias("payback_period"),
            (imp + F.col("signup_bonuses")).alias("first_year_benefit"),
            (imp / 12).alias("monthly_improvement"),
            F.when(fees > 0, imp / fees * 100).otherwise(F.lit(0.0)).alias("efficiency_pct"),
            improvement_band(imp).alias("improvement_band"),
            payback_band(payback).alias("payback_band"),
            payback_months_band(payback).alias("payback_months_band"),
            payback_months(payback).alias("payback_months"))

    def impact(self) -> DataFrame:
        """R8 + R9 + R21 (+ C24–C26): improvement over the current cards,
        bonuses, payback, first-year benefit and fee efficiency."""
        df = self._impact_cols(self.summary().filter(F.col("has_optimal")))
        return df.select(
            "client_id", "portfolio_id", "optimal_cards", "current_annual_rewards",
            "net_annual_rewards", F.col("_fees").alias("total_annual_fees"), "annual_improvement",
            "improvement_percentage", F.col("signup_bonuses").cast("long").alias("signup_bonuses"),
            "payback_period", "first_year_benefit", "monthly_improvement", "efficiency_pct",
            "improvement_band", "payback_band", "payback_months_band", "payback_months")

    # ---- R10 -------------------------------------------------------------
    def break_even(self) -> DataFrame:
        """For each fee-bearing card of the client's optimal portfolio,
        the annual spend at which its rewards pay the fee."""
        be = [(c.name, c.annual_fee, break_even(c)) for c in self.catalogue if c.annual_fee > 0]
        dim = self.spark.createDataFrame(be, "card string, annual_fee int, "
                                             "break_even_spending double")
        opt = self.optimal().select("client_id", F.explode("member_cards").alias("card"))
        return opt.join(F.broadcast(dim), "card").select(
            "client_id", "card", F.col("annual_fee").cast("long").alias("annual_fee"),
            "break_even_spending")

    # ---- R11 + F12 ------------------------------------------------------
    def recommendations(self) -> DataFrame:
        """High when the improvement exceeds 100 or bonuses exceed 500,
        Medium for a payback under two years; ordered High, Medium, Low."""
        out = self.impact().select("client_id", F.explode(self._recommended()).alias("r"))
        return out.select("client_id", "r.seq", "r.priority", "r.priority_rank", "r.title", "r.description", "r.action")

    @staticmethod
    def _recommended() -> Column:
        """The recommendations of a row of impact figures, by priority."""
        i, b, p = F.col("annual_improvement"), F.col("signup_bonuses"), F.col("payback_period")

        def rec(seq, value):
            prio, title, fmt, action = RECOMMENDATIONS[seq - 1]
            rank = {"High": 1, "Medium": 2}.get(prio, 3)
            return F.struct(F.lit(rank).cast("long").alias("priority_rank"), F.lit(seq).cast("long").alias("seq"),
                            F.lit(prio).alias("priority"), F.lit(title).alias("title"),
                            F.format_string(fmt, value).alias("description"), F.lit(action).alias("action"))

        return F.array_sort(F.array_compact(F.array(
            F.when(i > 100, rec(1, round_dec(i, 2))),
            F.when(b > 500, rec(2, b.cast("double"))),
            F.when((p > 0) & (p < 2), rec(3, round_dec(p, 1))))))

    # ---- R12 + R13 + J9 -------------------------------------------------
    def card_comparison(self) -> DataFrame:
        """R12 + R13 (+ J9): every catalogue card alone — gross, net, bonus,
        first-year value — ranked by net (catalogue order on ties), with
        payback months, ROI, reason label and membership of the optimal
        portfolio."""
        s = self.summary()
        cards = []
        for i, c in enumerate(self.catalogue):
            cards.append(F.struct(
                F.lit(i).cast("long").alias("card_ordinal"), F.lit(c.name).alias("card"),
                self._dot(lambda k, c=c: c.default_rate if k is None else c.rate(k)).alias("_g"),
                F.lit(c.annual_fee).cast("long").alias("annual_fee"),
                F.lit(c.signup_bonus).cast("long").alias("signup_bonus"),
                F.lit(BEST_FOR.get(c.name, "")).alias("best_for")))
        df = s.select("client_id", "has_optimal", "member_cards", F.inline(F.array(*cards)))
        net = (F.col("_g") - F.col("annual_fee")).cast(NET_T)
        df = df.select("*", net.alias("_n"))
        rank = F.row_number().over(Window.partitionBy("client_id").orderBy(
            F.col("_n").desc(), F.col("card_ordinal")))
        fee = F.col("annual_fee")
        netd = F.col("net_rewards")
        df = df.select(
            "client_id", "card_ordinal", "card", "annual_fee", "signup_bonus", "best_for", "_n",
            F.col("_g").cast("double").alias("gross_rewards"),
            F.col("_n").cast("double").alias("net_rewards"),
            (F.col("_n") + F.col("signup_bonus")).cast("double").alias("first_year_value"),
            rank.cast("long").alias("rank"),
            (F.col("has_optimal") & F.array_contains("member_cards", F.col("card")))
            .alias("in_optimal"))
        gross = F.col("gross_rewards")
        return df.select(
            "*",
            F.when((fee > 0) & (gross != 0), fee / gross * 12).otherwise(F.lit(0.0))
            .alias("payback_months"),
            F.when(fee > 0, (F.col("first_year_value") - fee) / fee * 100).otherwise(F.lit(0.0))
            .alias("roi_pct"),
            F.when((fee == 0) & (netd > 1000), REASONS[0])
             .when((fee > 0) & (netd > 1500), REASONS[1])
             .when(F.col("card").contains(DOUBLE_CASH_MARK), REASONS[2])
             .otherwise(REASONS[3]).alias("reason"),
            (F.col("rank") <= 3).alias("is_top3"))

    # ---- R14–R17 ----------------------------------------------------------
    def category_extra_rewards(self) -> DataFrame:
        """Per category, the extra reward of the optimal portfolio over
        a flat 1 % (``Current Card`` where no member beats 1 %), the client's
        headline totals, the action plan (top 3 with extra > 5) and the
        medians behind the opportunity matrix."""
        sp = self.category_spend()
        opt = self.optimal()
        df = self._with_portfolio_rates(sp, opt, "left")
        df = attach_per_client(self.ledger, df, opt.select("client_id", "primary_card"), "left")
        rate = F.coalesce(F.col("floor_rate"), _r(BASE))
        card = F.coalesce(F.col("floor_card"), F.lit(CURRENT_CARD))
        cur = (F.col("_spend") * _r(BASE)).cast(NET_T)
        pot = (F.col("_spend") * rate).cast(NET_T)
        df = df.select("client_id", "category", "_spend", "annual_spending",
                       F.coalesce("primary_card", F.lit("")).alias("primary_card"),
                       card.alias("best_card"), rate.alias("_rate"),
                       cur.alias("_cur"), pot.alias("_pot"), (pot - cur).alias("_add"))
        w = Window.partitionBy("client_id")
        rank = F.row_number().over(w.orderBy(F.col("_add").desc(), F.col("category")))
        big = F.col("_add") > ACTION_MIN_EXTRA
        # Qualifying rows sort first, so their row numbers are their ranks
        # among themselves (same partitioning as `w`: no extra exchange).
        act = F.row_number().over(w.orderBy(big.desc(), F.col("_add").desc(), F.col("category")))
        df = df.select(
            "*", rank.cast("long").alias("opportunity_rank"),
            F.when(big, act).otherwise(F.lit(0)).cast("long").alias("_act"))
        tc = F.sum("_cur").over(w)
        tp = F.sum("_pot").over(w)
        ta = F.sum("_add").over(w)
        best_cat = F.max(F.when((F.col("opportunity_rank") == 1) & (F.col("_add") > 0),
                                F.col("category"))).over(w)
        top_spend = F.min_by("category", F.struct(-F.col("_spend"), F.col("category"))).over(w)
        add_d = F.col("_add").cast("double")
        out = df.select(
            "client_id", "category", "annual_spending", "best_card", "primary_card",
            F.col("_cur").cast("double").alias("current_rewards"),
            F.col("_pot").cast("double").alias("potential_rewards"),
            add_d.alias("additional_rewards"),
            (F.col("_rate").cast("double") * 100).alias("best_reward_rate"),
            F.when(F.col("_cur") > 0, add_d / F.col("_cur").cast("double") * 100)
            .otherwise(F.lit(0.0)).alias("improvement_pct"),
            "opportunity_rank",
            F.when((F.col("_act") >= 1) & (F.col("_act") <= 3), F.col("_act"))
            .otherwise(F.lit(0).cast("long")).alias("action_priority"),
            tc.cast("double").alias("total_current"), tp.cast("double").alias("total_potential"),
            ta.cast("double").alias("total_additional"),
            F.coalesce(best_cat, F.lit("")).alias("best_category"),
            top_spend.alias("top_spend_category"),
            round_dec(F.percentile(F.col("annual_spending"), F.lit(0.5)).over(w), 6)
            .alias("median_spending"),
            round_dec(F.percentile(add_d, F.lit(0.5)).over(w), 6).alias("median_additional"))
        out = out.withColumn("uplift_pct", F.when(
            F.col("total_current") > 0,
            F.col("total_additional") / F.col("total_current") * 100).otherwise(F.lit(0.0)))
        is_act = F.col("action_priority") > 0
        return out.select(
            "*",
            F.when(is_act, F.format_string(ACTION_TEXT, F.col("category"), F.col("best_card"))).otherwise(F.lit("")).alias("action"),
            F.when(is_act, F.col("additional_rewards") / 12).otherwise(F.lit(0.0))
            .alias("monthly_impact"))

    # ---- R19 + R20 --------------------------------------------------------
    def coverage_and_advantage(self) -> DataFrame:
        """R19 + R20: share of spend whose best portfolio rate (1 % floor) beats
        1.5 %, and the portfolio's edge over the best single card."""
        s = self.summary().filter(F.col("has_optimal"))
        better = F.col("_net") > F.col("_single_net")
        return s.select(
            "client_id", "optimal_cards",
            F.when(F.col("_total") > 0, F.col("_covered").cast("double")
                   / F.col("_total").cast("double") * 100).otherwise(F.lit(0.0))
            .alias("coverage_pct"),
            "best_single_card", F.col("_single_net").cast("double").alias("best_single_net"),
            F.col("_net").cast("double").alias("portfolio_net"),
            better.alias("portfolio_better"),
            F.when(better, (F.col("_net") - F.col("_single_net")).cast("double"))
            .otherwise(F.lit(0.0)).alias("portfolio_advantage"))

    # ---- R22 --------------------------------------------------------------
    def five_year_projection(self, years: int = 5, carry_bonus: bool = False) -> DataFrame:
        """Cumulative rewards of the current cards and of the optimal
        portfolio per year; the signup bonus is added to year 1 only (or to
        every year with ``carry_bonus``)."""
        df = self.summary().filter(F.col("has_optimal")).select(
            "client_id", "_net", "_cur_total", "signup_bonuses",
            F.explode(F.sequence(F.lit(1), F.lit(years))).alias("year"))
        y = F.col("year")
        bonus = F.col("signup_bonuses") if carry_bonus else F.when(
            y == 1, F.col("signup_bonuses")).otherwise(F.lit(0))
        c = (F.col("_cur_total") * y).cast(NET_T)
        o = (F.col("_net") * y + bonus).cast(NET_T)
        return df.select("client_id", y.cast("long").alias("year"),
                         c.cast("double").alias("current_cumulative"),
                         o.cast("double").alias("optimal_cumulative"),
                         (o - c).cast("double").alias("difference"))

    # ---- R23 + R24 --------------------------------------------------------
    def card_usage_plan(self, min_spend: int = 100) -> DataFrame:
        """R23 + R24: for categories with more than ``min_spend`` a year, the
        portfolio card to use and its rate, with the card's highlight texts."""
        sp = self.category_spend().filter(F.col("_spend") > min_spend)
        df = self._with_portfolio_rates(sp, self.optimal(), "inner")
        hl = self.spark.createDataFrame(
            [(c.name, *highlights(c)) for c in self.catalogue],
            "best_card string, card_best_for string, card_high_rates string")
        df = df.join(F.broadcast(hl), "best_card", "left")
        return df.select("client_id", "category", "annual_spending", "best_card",
                         (F.col("best_rate").cast("double") * 100).alias("reward_rate_pct"),
                         "card_best_for", "card_high_rates")

    def portfolio_cards(self) -> DataFrame:
        """One row for each card of the client's optimal portfolio, in its
        order, whether or not it wins a category: fee, bonus, highlight texts and
        all listed rates, highest first (then by category)."""
        rows = []
        for c in self.catalogue:
            rates = sorted(c.rates, key=lambda kr: (-kr[1], kr[0]))
            rows.append((c.name, c.annual_fee, c.signup_bonus, *highlights(c),
                         [(i, k, r) for i, (k, r) in enumerate(rates, 1)]))
        dim = self.spark.createDataFrame(
            rows, "card string, annual_fee long, signup_bonus long, best_for string, high_rates string, "
                  "rates array<struct<rank:int,category:string,rate:decimal(6,4)>>")
        opt = self.optimal().select("client_id", F.posexplode("member_cards").alias("_at", "card"))
        return opt.join(dim, "card").select(
            "client_id", (F.col("_at") + 1).cast("long").alias("position"), "card", "annual_fee", "signup_bonus",
            "best_for", "high_rates", "rates")

    # ---- R25 ----------------------------------------------------------------
    def bundle(self) -> DataFrame:
        """One row per client with spending — the figures of the
        optimisation bundle, zeros where no portfolio has a positive net, and its
        parts as arrays of structs: ``current_cards`` (R3, by card id),
        ``top_categories`` (the five largest of R2), ``card_details`` (R24) and
        ``recommendations`` (R11, by priority); empty where there is none."""
        cards = current_portfolio(self.ledger).groupBy("client_id").agg(F.array_sort(F.collect_list(
            F.struct("card_id", "card_brand", "card_type", "credit_limit"))).alias("current_cards"))
        top = self.category_spend().where("in_top5").groupBy("client_id").agg(F.array_sort(F.collect_list(
            F.struct(F.col("spending_rank").alias("rank"), "category", "annual_spending"))).alias("top_categories"))
        df = self._bundle(parts=True)
        for part in (cards, top):
            df = attach_per_client(self.ledger, df, part, "left")
        return df.select(*[F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(c) if c in _PARTS else F.col(c)
                           for c in df.columns])

    def _card_details(self) -> Column:
        """R24 of the row's portfolio, from a constant array by place."""
        def card(i, c):
            return (f"named_struct('position', {i}L, 'card', {_sql(c.name)}, 'annual_fee', {c.annual_fee}L, "
                    f"'signup_bonus', {c.signup_bonus}L, 'best_for', {_sql(highlights(c)[0])})")
        every = ", ".join("array(" + ", ".join(card(i, c) for i, c in enumerate(p.cards(self.catalogue), 1)) + ")" for p in self.ports)
        return F.expr(f"element_at(array({every}), _place + 1)")

    def bundle_figures(self) -> DataFrame:
        """The figures of R25, one row per client with spending."""
        return self._bundle(parts=False)

    def _bundle(self, parts: bool) -> DataFrame:
        df = attach_per_client(self.ledger, self._impact_cols(self.summary()),
                               self.transaction_counts())
        opt = F.col("has_optimal")
        z = F.lit(0.0)

        def on(c, zero=z):
            return F.when(opt, F.col(c)).otherwise(zero)

        imp, b, p = (F.col("annual_improvement"), F.col("signup_bonuses"),
                     F.col("payback_period"))
        recs = (F.when(imp > 100, 1).otherwise(0) + F.when(b > 500, 1).otherwise(0)
                + F.when((p > 0) & (p < 2), 1).otherwise(0))
        return df.select(
            "client_id", F.col("_total").cast("double").alias("total_annual_spending"),
            "transaction_count", "current_annual_rewards", "has_optimal",
            on("optimal_cards", F.lit("")).alias("optimal_cards"),
            on("net_annual_rewards").alias("net_annual_rewards"),
            on("annual_improvement").alias("annual_improvement"),
            F.when(opt, b).otherwise(F.lit(0)).cast("long").alias("signup_bonuses"),
            on("first_year_benefit").alias("first_year_benefit"),
            on("payback_period").alias("payback_period"),
            F.when(opt, recs).otherwise(F.lit(0)).cast("long").alias("recommendation_count"),
            *([F.when(opt, self._card_details()).alias("card_details"),
               F.when(opt, self._recommended()).alias("recommendations")] if parts else []))

    # ---- R1 per client ------------------------------------------------------
    def catalogue_rates(self) -> DataFrame:
        """R1 applied: the rate every catalogue card pays on each category the
        client spends in (listed rate, else the card's default)."""
        sp = self.category_spend()
        cat = F.col("category")
        structs = []
        for i, c in enumerate(self.catalogue):
            rate = _r(c.default_rate)
            for k, r in reversed(c.rates):
                rate = F.when(cat == k, _r(r)).otherwise(rate)
            structs.append(F.struct(F.lit(i).cast("long").alias("card_ordinal"),
                                    F.lit(c.name).alias("card"), rate.alias("_rate"),
                                    F.lit(c.annual_fee).cast("long").alias("annual_fee"),
                                    F.lit(c.signup_bonus).cast("long").alias("signup_bonus")))
        df = sp.select("client_id", "category", "annual_spending", F.inline(F.array(*structs)))
        return df.select("client_id", "category", "annual_spending", "card_ordinal", "card",
                         F.col("_rate").cast("double").alias("rate"), "annual_fee",
                         "signup_bonus")


def owned_card_rewards(ledger: Ledger, period: str = "3_months") -> DataFrame:
    """J6 + R14 (owned variant): per client × category of the period (F3), the
    best flat brand rate among the client's own cards (first card by id on
    ties; brands without rates are skipped), against a 1 % baseline.  Clients
    without cards have no rows."""
    days = period_days(period)
    tx = spend_only(recent(ledger, days, columns=("client_id", "mcc", "amount", "date")))
    cs = (with_category(tx, ledger.mcc_codes, fallback="rewards").groupBy("client_id", "category")
          .agg(money_sum_dec("amount").cast(SPEND_T).alias("_spend")))
    cards = ledger.cards.select("client_id", F.col("id").alias("card_id"), "card_brand",
                                card_label("card_brand", "card_type").alias("_label"))
    df = cs.join(cards, "client_id")
    cat, brand = F.col("category"), F.col("card_brand")
    rate = F.lit(None).cast(RATE_T)
    for b, (rates, default) in reversed(list(BRAND_RATES.items())):
        r = _r(default)
        for k, v in reversed(list(rates.items())):
            r = F.when(cat == k, _r(v)).otherwise(r)
        rate = F.when(brand == b, r).otherwise(rate)
    df = df.withColumn("_rate", rate)
    key = F.when(F.col("_rate").isNotNull(), F.struct(-F.col("_rate"), F.col("card_id")))
    g = df.groupBy("client_id", "category").agg(
        F.first("_spend").alias("_spend"), F.max("_rate").alias("_best"),
        F.min_by("_label", key).alias("_card"))
    best = F.coalesce(F.col("_best"), F.lit(0).cast(RATE_T))
    cur = (F.col("_spend") * _r(BASE)).cast(NET_T)
    pot = (F.col("_spend") * best).cast(NET_T)
    add = (pot - cur)
    return g.select(
        "client_id", "category", F.col("_spend").cast("double").alias("spending"),
        cur.cast("double").alias("current_rewards"), pot.cast("double").alias("potential_rewards"),
        add.cast("double").alias("additional_rewards"),
        F.coalesce("_card", F.lit(CURRENT_CARD)).alias("best_card"),
        (best.cast("double") * 100).alias("best_reward_rate"),
        F.when(cur > 0, add.cast("double") / cur.cast("double") * 100).otherwise(F.lit(0.0))
        .alias("improvement_pct"))
