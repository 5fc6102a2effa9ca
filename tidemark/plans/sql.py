"""The same results in DuckDB SQL, written independently of the DataFrame operators, as named common table expressions."""

from __future__ import annotations

import re

from tidemark.functions.scalars import STREET_TYPES
from tidemark.sources.canonical import FIRST_NAMES, LAST_NAMES, STREETS, VARIANTS

AS_OF = "DATE '2001-07-31'"


def r4(x: str) -> str:
    """Round half up to four places, the same in every engine."""
    return f"floor(({x})*10000+0.5+1e-6)/10000"


def one(x: str) -> str:
    return f"floor(({x})*10+0.5+1e-9)/10"


def cents(x: str) -> str:
    return f"floor(({x})*100+0.5+1e-6)/100"


def pct(value: str, table: str, out: str) -> str:
    return f"(rank() OVER (ORDER BY {value}) - 1 + (count(*) OVER (PARTITION BY {value}) + 1)/2.0::DOUBLE) / count(*) OVER () AS {out}"


def bucket(key: str, salt: str, size: int) -> str:
    return f"(('0x'||substr(md5('{salt}'||CAST({key} AS VARCHAR)),1,7))::INT % {size})"


def choose(values: tuple, index: str) -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in values)
    return f"([{items}])[({index})+1]"


def quint(value: str, table: str) -> str:
    return f"CASE WHEN count(*) OVER () = 1 THEN 1 ELSE greatest(1, ceil(5.0::DOUBLE*(row_number() OVER (ORDER BY {value}, golden_customer_id)-1)/(count(*) OVER ()-1))) END"


def dates(values) -> str:  # noqa: ANN001
    return "(VALUES " + ", ".join(f"(DATE '{d}')" for d in values) + ")"


REENGAGE = ["1999-01-31", "1999-04-30", "1999-07-31", "1999-10-31", "2000-01-31", "2000-04-30", "2000-07-31", "2000-10-31", "2001-01-31", "2001-04-30"]
CAMPAIGN = [f"{y}-{m}-15" for y in (1999, 2000, 2001) for m in ("02", "05", "08", "11") if (y, m) <= (2001, "05")]
IN_RECENT = "transaction_date BETWEEN DATE '2001-02-02' AND DATE '2001-07-31'"
IN_PRIOR = "transaction_date BETWEEN DATE '2000-08-06' AND DATE '2001-02-01'"


def history(source: str, name: str) -> dict[str, str]:
    """Snapshot features over rows (observation_date, tx.*) of `source`."""
    k, g = "observation_date, golden_customer_id", "GROUP BY observation_date, golden_customer_id"
    back = "date_diff('day', transaction_date, observation_date)"
    sums = lambda cond, o, s, m: f"count(DISTINCT CASE WHEN {cond} THEN order_id END) {o}, coalesce(sum(CASE WHEN {cond} THEN net_sales END),0) {s}, coalesce(sum(CASE WHEN {cond} THEN gross_margin END),0) {m}"
    return {
        f"{name}_h": f"SELECT *, {back} back FROM {source} WHERE transaction_date <= observation_date",
        f"{name}_base": f"""SELECT {k}, count(DISTINCT order_id) lifetime_orders, sum(net_sales) lifetime_sales, sum(gross_margin) lifetime_margin, CAST(sum(units) AS BIGINT) lifetime_units,
            avg(net_sales) avg_order_value, avg(gross_margin) avg_margin_per_order, avg(discount_pct) avg_discount_pct, avg(CASE WHEN coalesce(discount_pct,0)>0 THEN 1 ELSE 0 END) discounted_order_share,
            count(DISTINCT channel) channels_used, count(DISTINCT category) categories_used, min(back) days_since_last_purchase, max(back) purchase_tenure_days,
            {sums("back<=179", "orders_prior_180d", "sales_prior_180d", "margin_prior_180d")}, {sums("back<=364", "orders_prior_365d", "sales_prior_365d", "margin_prior_365d")},
            count(DISTINCT CASE WHEN back<=179 THEN category END) categories_prior_180d, count(DISTINCT CASE WHEN back<=364 THEN category END) categories_prior_365d,
            {sums("back<=179", "recent_orders", "recent_sales", "recent_margin")}, {sums("back BETWEEN 180 AND 359", "prior_orders", "prior_sales", "prior_margin")} FROM {name}_h {g}""",
        f"{name}_gap": f"SELECT {k}, date_diff('day', lag(transaction_date) OVER (PARTITION BY {k} ORDER BY transaction_date), transaction_date) gap FROM (SELECT DISTINCT {k}, transaction_date FROM {name}_h)",
        f"{name}_gaps": f"SELECT {k}, count(gap) observed_purchase_gaps, median(gap) median_purchase_gap_days, avg(gap) mean_purchase_gap_days, stddev_samp(gap) std_purchase_gap_days FROM {name}_gap {g}",
        f"{name}_cat": f"SELECT {k}, max(n)/sum(n)::DOUBLE dominant_category_share, sum(n*n)/(sum(n)*sum(n))::DOUBLE category_concentration, max(s)/sum(s) dominant_category_sales_share FROM (SELECT {k}, category, count(DISTINCT order_id) n, sum(net_sales) s FROM {name}_h {g}, category) {g}",
        f"{name}_ch": f"SELECT {k}, max(n)/sum(n)::DOUBLE preferred_channel_share FROM (SELECT {k}, channel, count(DISTINCT order_id) n FROM {name}_h {g}, channel) {g}",
        f"{name}_all": f"""SELECT *, lifetime_margin/nullif(lifetime_sales,0) margin_rate, std_purchase_gap_days/nullif(mean_purchase_gap_days,0) cadence_cv, days_since_last_purchase/nullif(median_purchase_gap_days,0) adjusted_lapse_ratio,
            (recent_orders-prior_orders)/nullif(prior_orders,0)::DOUBLE order_change_pct, (recent_sales-prior_sales)/nullif(prior_sales,0) sales_change_pct
            FROM {name}_base JOIN {name}_gaps USING ({k}) JOIN {name}_cat USING ({k}) JOIN {name}_ch USING ({k})""",
    }


CTES: dict[str, str] = {
    "li": "SELECT l.*, p.p_type, p.p_size, l_extendedprice*(1-l_discount) net, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_discount DESC) rn FROM lineitem l JOIN part p ON l_partkey=p_partkey",
    "lo": f"SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) units, {cents('sum(l_extendedprice)')} gross_sales, {cents('sum(net)')} net_sales, {cents('sum(net*(0.12::DOUBLE+0.43::DOUBLE*(p_size-1)/49))')} gross_margin, max(CASE WHEN rn=1 THEN p_type END) category, greatest(0::DOUBLE, {cents('max(CASE WHEN rn=1 THEN l_discount END)-0.05::DOUBLE')}) discount_pct FROM li GROUP BY 1",
    "tx": f"SELECT o_orderkey order_id, o_custkey golden_customer_id, CAST(o_orderdate AS DATE) transaction_date, CASE o_orderstatus WHEN 'F' THEN 'Store' WHEN 'O' THEN 'Online' ELSE 'Click & Collect' END channel, category, units, gross_sales, discount_pct, net_sales, {cents('net_sales-gross_margin')} AS cost, gross_margin FROM orders JOIN lo ON o_orderkey=l_orderkey WHERE CAST(o_orderdate AS DATE) <= {AS_OF}",
    "cust": "SELECT c_custkey golden_customer_id, n_name state, c_mktsegment market_segment FROM customer LEFT JOIN nation ON c_nationkey=n_nationkey",
    "summ0": "SELECT golden_customer_id, min(transaction_date) first_purchase_date, max(transaction_date) last_purchase_date, count(DISTINCT order_id) orders, CAST(sum(units) AS BIGINT) units, sum(net_sales) net_sales, sum(gross_margin) gross_margin FROM tx GROUP BY 1",
    "summ": f"SELECT c.golden_customer_id, first_purchase_date, last_purchase_date, coalesce(orders,0) orders, coalesce(units,0) units, coalesce(net_sales,0) net_sales, coalesce(gross_margin,0) gross_margin, coalesce(net_sales/nullif(orders,0),0) avg_order_value, date_diff('day',last_purchase_date,{AS_OF}) days_since_last_purchase, date_diff('day',first_purchase_date,{AS_OF}) purchase_tenure_days FROM cust c LEFT JOIN summ0 s ON c.golden_customer_id=s.golden_customer_id",
    "gaps": "SELECT * FROM (SELECT golden_customer_id, transaction_date, date_diff('day', lag(transaction_date) OVER (PARTITION BY golden_customer_id ORDER BY transaction_date), transaction_date) gap_days FROM (SELECT DISTINCT golden_customer_id, transaction_date FROM tx)) WHERE gap_days IS NOT NULL",
    "cad": "SELECT golden_customer_id, count(gap_days) observed_purchase_gaps, median(gap_days) median_purchase_gap_days, avg(gap_days) mean_purchase_gap_days, stddev_samp(gap_days) std_purchase_gap_days, stddev_samp(gap_days)/nullif(avg(gap_days),0) cadence_cv FROM gaps GROUP BY 1",
    "trail": "SELECT golden_customer_id, count(DISTINCT order_id) trailing_12m_orders, sum(net_sales) trailing_12m_sales, sum(gross_margin) trailing_12m_margin FROM tx WHERE transaction_date > DATE '2000-07-31' GROUP BY 1",
    "feat0": "SELECT s.*, coalesce(observed_purchase_gaps,0) observed_purchase_gaps, median_purchase_gap_days, mean_purchase_gap_days, std_purchase_gap_days, cadence_cv, coalesce(trailing_12m_orders,0) trailing_12m_orders, coalesce(trailing_12m_sales,0) trailing_12m_sales, coalesce(trailing_12m_margin,0) trailing_12m_margin, days_since_last_purchase/nullif(median_purchase_gap_days,0) lapse_ratio, CASE WHEN median_purchase_gap_days IS NOT NULL THEN greatest(median_purchase_gap_days,7) END expected_return_days FROM summ s LEFT JOIN cad USING (golden_customer_id) LEFT JOIN trail USING (golden_customer_id)",
    "feat1": "SELECT *, days_since_last_purchase/nullif(expected_return_days,0) adjusted_lapse_ratio, CASE WHEN observed_purchase_gaps>=5 THEN 'High' WHEN observed_purchase_gaps>=2 THEN 'Medium' ELSE 'Low' END cadence_confidence, coalesce(days_since_last_purchase<=365,false) active_customer FROM feat0",
    "feat": "SELECT *, CASE WHEN orders=0 THEN 'Acquired / Never Purchased' WHEN cadence_confidence='Low' AND active_customer THEN 'Active / Limited History' WHEN cadence_confidence='Low' THEN 'Inactive / Limited History' WHEN adjusted_lapse_ratio<1 THEN 'On Cadence' WHEN adjusted_lapse_ratio<1.5 THEN 'Watch' WHEN adjusted_lapse_ratio<2 THEN 'At Risk' WHEN adjusted_lapse_ratio>=2 THEN 'Highly Lapsed' ELSE 'Unclassified' END lifecycle_status FROM feat1",
    "per": "SELECT golden_customer_id, min(transaction_date) first_purchase_date, " + ", ".join(f"count(DISTINCT CASE WHEN {c} THEN order_id END) {n}_orders, sum(CASE WHEN {c} THEN net_sales ELSE 0 END) {n}_sales, sum(CASE WHEN {c} THEN gross_margin ELSE 0 END) {n}_margin, CAST(sum(CASE WHEN {c} THEN units ELSE 0 END) AS BIGINT) {n}_units" for n, c in (("recent", IN_RECENT), ("prior", IN_PRIOR))) + " FROM tx GROUP BY 1",
    "pgap": f"SELECT golden_customer_id, period, date_diff('day', lag(transaction_date) OVER (PARTITION BY golden_customer_id, period ORDER BY transaction_date), transaction_date) gap FROM (SELECT DISTINCT golden_customer_id, transaction_date, CASE WHEN {IN_RECENT} THEN 'recent' WHEN {IN_PRIOR} THEN 'prior' END period FROM tx) WHERE period IS NOT NULL",
    "pcad": "SELECT golden_customer_id, median(gap) FILTER (period='recent') recent_median_gap, count(gap) FILTER (period='recent') recent_gaps, median(gap) FILTER (period='prior') prior_median_gap, count(gap) FILTER (period='prior') prior_gaps FROM pgap GROUP BY 1",
    "mom0": "SELECT c.golden_customer_id, p.first_purchase_date, " + ", ".join(f"coalesce({n}_{x},0) {n}_{x}" for n in ("recent", "prior") for x in ("orders", "sales", "margin", "units", "gaps")) + ", recent_sales/nullif(recent_orders,0) recent_aov, prior_sales/nullif(prior_orders,0) prior_aov, recent_median_gap, prior_median_gap FROM cust c LEFT JOIN per p ON c.golden_customer_id=p.golden_customer_id LEFT JOIN pcad g ON c.golden_customer_id=g.golden_customer_id",
    "mom1": "SELECT *, " + ", ".join(f"CASE WHEN prior_{a}>0 THEN (recent_{a}-prior_{a})/prior_{a}::DOUBLE END {b}_change_pct" for a, b in (("orders", "order"), ("sales", "sales"), ("margin", "margin"), ("aov", "aov"), ("median_gap", "cadence"))) + ", coalesce(first_purchase_date <= DATE '2001-02-01', false) comparable_history FROM mom0",
    "mom2": "SELECT *, comparable_history AND recent_gaps>=2 AND prior_gaps>=2 cadence_comparable FROM mom1",
    "mom3": "SELECT *, " + ", ".join(f"CAST(coalesce(cadence_comparable AND cadence_change_pct>={c},false) AS INT)+CAST(coalesce(order_change_pct<=-{c},false) AS INT)+CAST(coalesce(sales_change_pct<=-{c},false) AS INT) {n}" for c, n in ((0.25, "momentum_risk_signals"), (0.5, "strong_momentum_risk_signals"))) + " FROM mom2",
    "mom": "SELECT *, CASE WHEN NOT comparable_history OR prior_orders=0 THEN 'Insufficient History' WHEN prior_orders>0 AND recent_orders=0 THEN 'No Recent Purchase' WHEN strong_momentum_risk_signals>=2 THEN 'Strongly Deteriorating' WHEN momentum_risk_signals>=2 THEN 'Deteriorating' WHEN coalesce(order_change_pct>=0.25 AND sales_change_pct>=0.25,false) THEN 'Improving' ELSE 'Stable / Mixed' END momentum_status FROM mom3",
    "tg": "SELECT *, row_number() OVER (PARTITION BY golden_customer_id ORDER BY transaction_date) seq, count(*) OVER (PARTITION BY golden_customer_id) n FROM gaps",
    "tr0": "SELECT golden_customer_id, count(*) trend_gaps, regr_slope(gap_days,seq) slope, CASE WHEN var_pop(gap_days)=0 THEN 0 ELSE regr_r2(gap_days,seq) END r2, median(gap_days) med, median(gap_days) FILTER (seq<=n//2) early, median(gap_days) FILTER (seq>n//2) late FROM tg GROUP BY 1",
    "tr1": "SELECT c.golden_customer_id, coalesce(trend_gaps,0) trend_gaps, CASE WHEN trend_gaps>=5 THEN slope END trend_slope, CASE WHEN trend_gaps>=5 THEN r2 END trend_r2, CASE WHEN trend_gaps>=5 AND med>0 THEN slope/med END gap_trend_pct, CASE WHEN trend_gaps>=5 AND early>0 THEN (late-early)/early END recent_vs_early_pct FROM cust c LEFT JOIN tr0 t ON c.golden_customer_id=t.golden_customer_id",
    "trend": "SELECT *, CASE WHEN trend_gaps<5 THEN 'Insufficient History' WHEN coalesce(gap_trend_pct>=0.03 AND trend_r2>=0.20 AND recent_vs_early_pct>=0.25,false) THEN 'Strongly Deteriorating' WHEN coalesce(gap_trend_pct>=0.015 AND recent_vs_early_pct>=0.15,false) THEN 'Deteriorating' WHEN coalesce(gap_trend_pct<=-0.015 AND recent_vs_early_pct<=-0.15,false) THEN 'Improving' ELSE 'Stable / Mixed' END cadence_trend_status FROM tr1",
    "rfm0": f"SELECT golden_customer_id, date_diff('day',max(transaction_date),{AS_OF}) recency_days, count(DISTINCT order_id) frequency, {cents('sum(net_sales)')} monetary_sales, {cents('sum(gross_margin)')} monetary_margin FROM tx GROUP BY 1",
    "rfm": f"SELECT *, CAST(6-{quint('recency_days', 'rfm0')} AS BIGINT) recency_score, CAST({quint('frequency', 'rfm0')} AS BIGINT) frequency_score, CAST({quint('monetary_margin', 'rfm0')} AS BIGINT) monetary_score FROM rfm0",
    "val0": f"SELECT f.golden_customer_id, orders, net_sales, gross_margin, trailing_12m_orders, trailing_12m_sales, trailing_12m_margin, recency_days, frequency, monetary_sales, monetary_margin, recency_score, frequency_score, monetary_score, coalesce(recency_score,0)+coalesce(frequency_score,0)+coalesce(monetary_score,0) rfm_score, {cents('trailing_12m_margin')} mm, {cents('trailing_12m_sales')} ss FROM feat f LEFT JOIN rfm r ON f.golden_customer_id=r.golden_customer_id",
    "val1": f"SELECT *, {pct('mm', 'val0', 'mp')}, {pct('ss', 'val0', 'sp')} FROM val0",
    "value": f"SELECT * EXCLUDE (mm,ss,mp,sp), CASE WHEN orders=0 THEN 'No Purchase' WHEN mp>=0.9 THEN 'Very High' WHEN mp>=0.7 THEN 'High' WHEN mp>=0.4 THEN 'Medium' ELSE 'Low' END customer_value_tier, CASE WHEN orders=0 THEN 0 ELSE {one('100*(0.65::DOUBLE*mp+0.35::DOUBLE*sp)')} END commercial_value_score, CASE WHEN orders=0 THEN 'No Purchase' WHEN recency_score>=4 AND frequency_score>=4 AND monetary_score>=4 THEN 'Champions' WHEN recency_score>=3 AND frequency_score>=4 AND monetary_score>=3 THEN 'Loyal' WHEN monetary_score>=4 AND recency_score<=2 THEN 'Historically Valuable' WHEN monetary_score=5 THEN 'High Value' WHEN recency_score>=4 AND frequency_score<=3 THEN 'Developing' WHEN frequency_score IN (2,3) AND recency_score>=2 THEN 'Occasional' WHEN frequency_score<=2 AND monetary_score<=2 THEN 'Low Engagement' ELSE 'Core' END rfm_segment FROM val1",
    "pr0": f"SELECT v.*, lifecycle_status, cadence_confidence, adjusted_lapse_ratio, active_customer, days_since_last_purchase, momentum_status, momentum_risk_signals, order_change_pct, sales_change_pct, trend_gaps, gap_trend_pct, cadence_trend_status, least(greatest(commercial_value_score,0),100) value_score, CASE WHEN cadence_confidence='Low' THEN 0 ELSE {one('least(greatest(CASE WHEN r<1 THEN 40*r WHEN r<1.5 THEN 40+(r-1)/0.5::DOUBLE*20 WHEN r<2 THEN 60+(r-1.5::DOUBLE)/0.5::DOUBLE*20 WHEN r<3 THEN 80+(r-2)*20 ELSE 100 END,0),100)')} END lapse_score, CASE cadence_trend_status WHEN 'Strongly Deteriorating' THEN 100 WHEN 'Deteriorating' THEN 70 WHEN 'Stable / Mixed' THEN 20 ELSE 0 END momentum_score FROM value v JOIN (SELECT *, coalesce(adjusted_lapse_ratio,0) r FROM feat) f USING (golden_customer_id) JOIN mom USING (golden_customer_id) JOIN trend USING (golden_customer_id)".replace("SELECT v.*,", "SELECT v.golden_customer_id, v.* EXCLUDE (golden_customer_id),"),
    "pr1": f"SELECT *, {one('least(greatest(0.40::DOUBLE*value_score+0.35::DOUBLE*lapse_score+0.25::DOUBLE*momentum_score,0),100)')} priority_score, customer_value_tier IN ('High','Very High') hv, customer_value_tier IN ('Medium','High','Very High') mv, lifecycle_status IN ('At Risk','Highly Lapsed') hard, cadence_trend_status IN ('Deteriorating','Strongly Deteriorating') det FROM pr0",
    "prio": "SELECT * EXCLUDE (hv,mv,hard,det), CASE WHEN customer_value_tier='No Purchase' OR orders=0 THEN 'Acquisition Opportunity' WHEN hv AND hard THEN 'Protect Now' WHEN hv AND lifecycle_status='On Cadence' AND det THEN 'Proactive Retention' WHEN mv AND cadence_trend_status='Strongly Deteriorating' THEN 'Proactive Retention' WHEN mv AND hard THEN 'Re-engage' WHEN mv AND (lifecycle_status='Watch' OR det) THEN 'Watch Closely' WHEN rfm_segment='Developing' AND active_customer THEN 'Develop' WHEN hv AND lifecycle_status='On Cadence' THEN 'Maintain' WHEN cadence_trend_status='Improving' AND mv THEN 'Maintain' ELSE 'Low Priority' END decision_group, CASE WHEN priority_score>=75 THEN 'Critical' WHEN priority_score>=55 THEN 'High' WHEN priority_score>=35 THEN 'Medium' ELSE 'Low' END priority_band FROM pr1",
    "fst": "SELECT golden_customer_id, min(transaction_date) f FROM tx GROUP BY 1",
    "ltv0": "SELECT golden_customer_id, f first_purchase_date, count(DISTINCT order_id) lifetime_orders, sum(net_sales) lifetime_sales, sum(gross_margin) lifetime_margin, " + ", ".join(f"sum(CASE WHEN transaction_date < f + INTERVAL {n} MONTH THEN net_sales ELSE 0 END) s{n}, sum(CASE WHEN transaction_date < f + INTERVAL {n} MONTH THEN gross_margin ELSE 0 END) g{n}" for n in (3, 6, 12, 18, 24)) + " FROM tx JOIN fst USING (golden_customer_id) GROUP BY 1, 2",
    "snd": "SELECT golden_customer_id, transaction_date second_purchase_date FROM (SELECT *, row_number() OVER (PARTITION BY golden_customer_id ORDER BY transaction_date, order_id) k FROM (SELECT DISTINCT golden_customer_id, transaction_date, order_id FROM tx)) WHERE k=2",
    "ltv": f"SELECT c.golden_customer_id, first_purchase_date, lifetime_orders, lifetime_sales, lifetime_margin, second_purchase_date, CAST(date_trunc('month',first_purchase_date) AS DATE) cohort_month, date_diff('day',first_purchase_date,{AS_OF}) tenure_days, date_diff('day',first_purchase_date,second_purchase_date) days_to_second_purchase, first_purchase_date IS NOT NULL has_purchased, coalesce(lifetime_orders>=2,false) repeat_customer, lifetime_margin/nullif(lifetime_sales,0) lifetime_margin_rate, " + ", ".join(f"coalesce(first_purchase_date + INTERVAL {n} MONTH <= {AS_OF},false) m{n}_mature, CASE WHEN first_purchase_date + INTERVAL {n} MONTH <= {AS_OF} THEN s{n} END m{n}_sales, CASE WHEN first_purchase_date + INTERVAL {n} MONTH <= {AS_OF} THEN g{n} END m{n}_margin" for n in (3, 6, 12, 18, 24)) + " FROM cust c LEFT JOIN ltv0 l ON c.golden_customer_id=l.golden_customer_id LEFT JOIN snd s ON c.golden_customer_id=s.golden_customer_id",
    "coh": "SELECT golden_customer_id, CAST(date_trunc('month',f) AS DATE) cohort_month FROM fst",
    "grid": f"SELECT cohort_month, cohort_size, unnest(range(0, CAST(date_diff('month',cohort_month,{AS_OF}) AS BIGINT)+1)) age_months FROM (SELECT cohort_month, count(*) cohort_size FROM coh GROUP BY 1)",
    "act": "SELECT cohort_month, date_diff('month',cohort_month,transaction_date) age_months, count(DISTINCT golden_customer_id) active FROM tx JOIN coh USING (golden_customer_id) GROUP BY 1,2",
    "ret": "SELECT cohort_month, age_months, cohort_size, coalesce(active,0) active_customers, coalesce(active,0)/cohort_size::DOUBLE retention_rate FROM grid LEFT JOIN act USING (cohort_month, age_months)",
    "mv0": "SELECT golden_customer_id, transaction_date, lag(transaction_date) OVER w prev, max(transaction_date) OVER (PARTITION BY golden_customer_id) last, date_diff('day', lag(transaction_date) OVER w, transaction_date) gap FROM (SELECT DISTINCT golden_customer_id, transaction_date FROM tx) WINDOW w AS (PARTITION BY golden_customer_id ORDER BY transaction_date)",
    "mv1": "SELECT *, count(gap) OVER p n_prior, quantile_cont(gap,0.5) OVER p med_prior, count(gap) OVER a n_all, quantile_cont(gap,0.5) OVER a med_all FROM mv0 WINDOW p AS (PARTITION BY golden_customer_id ORDER BY transaction_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY golden_customer_id ORDER BY transaction_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "mv2": f"SELECT *, 2*greatest(7,med_prior) lim_p, 2*greatest(7,med_all) lim_a, date_diff('day',transaction_date,{AS_OF}) open_gap FROM mv1",
    "events_": f"""SELECT * FROM (SELECT golden_customer_id, 'New' event_type, transaction_date event_date, 1 change FROM mv2 WHERE prev IS NULL
        UNION ALL SELECT golden_customer_id, 'Lapsed', prev + CAST(ceil(lim_p) AS INT), -1 FROM mv2 WHERE n_prior>=2 AND gap>lim_p
        UNION ALL SELECT golden_customer_id, 'Reactivated', transaction_date, 1 FROM mv2 WHERE n_prior>=2 AND gap>lim_p
        UNION ALL SELECT golden_customer_id, 'Lapsed', transaction_date + CAST(ceil(lim_a) AS INT), -1 FROM mv2 WHERE transaction_date=last AND n_all>=2 AND open_gap>lim_a) WHERE event_date <= {AS_OF}""",
    "mon": f"SELECT CAST(unnest(generate_series((SELECT date_trunc('month',min(transaction_date)) FROM tx), date_trunc('month',{AS_OF}), INTERVAL 1 MONTH)) AS DATE) AS month",
    "gro0": "SELECT month, " + ", ".join(f"count(DISTINCT golden_customer_id) FILTER (event_type='{k}') {n}" for k, n in (("New", "new_customers"), ("Reactivated", "reactivated_customers"), ("Lapsed", "lapsed_customers"))) + " FROM mon LEFT JOIN events_ ON month=CAST(date_trunc('month',event_date) AS DATE) GROUP BY 1",
    "gro1": "SELECT *, new_customers+reactivated_customers-lapsed_customers net_change FROM gro0",
    "gro2": "SELECT *, CAST(sum(net_change) OVER (ORDER BY month) AS BIGINT) closing_customers FROM gro1",
    "gro": "SELECT *, coalesce(lag(closing_customers) OVER (ORDER BY month),0) opening_customers FROM gro2",
    "cs0": "SELECT cohort_month, count(*) customers, CAST(sum(CAST(repeat_customer AS INT)) AS BIGINT) repeat_customers, CAST(sum(lifetime_orders) AS BIGINT) orders, sum(lifetime_sales) sales, sum(lifetime_margin) margin, " + ", ".join(f"avg(m{n}_margin) a{n}" for n in (3, 6, 12, 18, 24)) + " FROM ltv WHERE has_purchased GROUP BY 1",
    "cs1": "SELECT c.*, " + ", ".join(f"CASE WHEN last_day(cohort_month) + INTERVAL {n} MONTH <= {AS_OF} THEN a{n} END avg_m{n}_margin, CASE WHEN last_day(cohort_month) + INTERVAL {n} MONTH <= {AS_OF} THEN (SELECT retention_rate FROM ret r WHERE r.cohort_month=c.cohort_month AND age_months={n}) END retention_m{n}" for n in (3, 6, 12, 18, 24)) + " FROM cs0 c",
    "cs2": "SELECT *, CASE WHEN retention_m6 IS NOT NULL AND count(retention_m6) OVER w>=3 THEN avg(retention_m6) OVER w END m6_benchmark FROM cs1 WINDOW w AS (PARTITION BY retention_m6 IS NULL ORDER BY cohort_month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)",
    "fun0": f"SELECT golden_customer_id, f FROM fst WHERE f <= DATE '2000-07-31'",
    "fun1": "SELECT t.golden_customer_id, count(DISTINCT CASE WHEN date_diff('month',f,transaction_date) BETWEEN 0 AND 11 THEN order_id END)>=3 a, bool_or(date_diff('month',f,transaction_date) BETWEEN 6 AND 11) b, bool_or(date_diff('month',f,transaction_date)>=12) c FROM tx t JOIN fun0 USING (golden_customer_id) GROUP BY 1",
    "fun": "SELECT count(*) s0, count(*) FILTER (a) s1, count(*) FILTER (a AND b) s2, count(*) FILTER (a AND b AND c) s3, count(*) FILTER (a AND b AND c AND customer_value_tier IN ('High','Very High')) s4 FROM fun1 JOIN value USING (golden_customer_id)",
    "re_rows": f"SELECT d.d observation_date, tx.* FROM tx, {dates(REENGAGE)} d(d)",
    "xs_rows": f"SELECT d.d observation_date, tx.* FROM tx, {dates(REENGAGE[:-1])} d(d)",
    **history("re_rows", "re"),
    **history("xs_rows", "xs"),
    "re_out": "SELECT observation_date, golden_customer_id, count(DISTINCT order_id) future_orders_90d, sum(net_sales) future_sales_90d, sum(gross_margin) future_margin_90d FROM re_rows WHERE transaction_date>observation_date AND transaction_date<=observation_date+90 GROUP BY 1,2",
    "re_train": "SELECT a.*, coalesce(future_orders_90d,0) future_orders_90d, coalesce(future_sales_90d,0) future_sales_90d, CASE WHEN coalesce(future_orders_90d,0)>0 THEN 1 ELSE 0 END purchased_next_90d FROM re_all a LEFT JOIN re_out o ON a.observation_date=o.observation_date AND a.golden_customer_id=o.golden_customer_id WHERE lifetime_orders>=3 AND observed_purchase_gaps>=2 AND purchase_tenure_days>=180 AND days_since_last_purchase>=45 AND adjusted_lapse_ratio>=1.5",
    "xs_new": "SELECT observation_date, golden_customer_id, count(*) n FROM (SELECT observation_date, golden_customer_id, category FROM xs_rows GROUP BY 1,2,3 HAVING min(transaction_date)>observation_date AND min(transaction_date)<=observation_date+180) GROUP BY 1,2",
    "xs_train": "SELECT a.*, (SELECT count(DISTINCT category) FROM tx)-categories_used category_whitespace_count, coalesce(n,0) new_category_count, CASE WHEN n>0 THEN 1 ELSE 0 END cross_sell_next_180d FROM xs_all a LEFT JOIN xs_new o ON a.observation_date=o.observation_date AND a.golden_customer_id=o.golden_customer_id WHERE lifetime_orders>=3 AND purchase_tenure_days>=180 AND (SELECT count(DISTINCT category) FROM tx)>categories_used",
    "exb": f"SELECT golden_customer_id, d.d campaign_date, count(*) FILTER (transaction_date<d.d) prior, min(transaction_date) FILTER (transaction_date<d.d) f, list(DISTINCT category) FILTER (transaction_date>d.d AND transaction_date<=d.d+30) bought FROM tx, {dates(CAMPAIGN)} d(d) GROUP BY 1,2",
    "exu": "SELECT *, CAST(golden_customer_id AS VARCHAR)||'|'||CAST(campaign_date AS VARCHAR) u FROM exb WHERE prior>=2 AND date_diff('day',f,campaign_date)>=90",
    "exq": f"SELECT 'EXP_'||md5(u) exposure_id, 'CMP_'||strftime(campaign_date,'%Y%m') campaign_id, campaign_date, golden_customer_id, CASE WHEN {bucket('u', 'treat', 100)}<80 THEN 1 ELSE 0 END treatment_flag, {choose(('Email', 'SMS', 'App'), bucket('u', 'channel', 3))} campaign_channel, {choose(('ECONOMY', 'STANDARD', 'PROMO', 'MEDIUM', 'SMALL', 'LARGE'), bucket('u', 'offer', 6))} offer_category, {choose((0.1, 0.15, 0.2, 0.25), bucket('u', 'depth', 4))} discount_depth, bought, {bucket('u', 'respond', 1000)} draw FROM exu WHERE {bucket('u', 'audience', 100)}<38",
    "expo": "SELECT * EXCLUDE (bought,draw), CASE WHEN coalesce(list_contains(bought,offer_category),false) OR draw < (CASE WHEN treatment_flag=1 THEN 60+600*discount_depth ELSE 40 END) THEN 1 ELSE 0 END responded FROM exq",
    "ptr": "SELECT e.exposure_id, count(DISTINCT order_id) lifetime_orders, sum(net_sales) lifetime_sales, avg(net_sales) average_order_value, date_diff('day',max(transaction_date),any_value(campaign_date)) days_since_last_purchase, date_diff('day',min(transaction_date),any_value(campaign_date)) customer_tenure_days, count(DISTINCT CASE WHEN transaction_date>=campaign_date-180 THEN order_id END) orders_prior_180d, count(DISTINCT CASE WHEN category=offer_category THEN order_id END) offer_category_prior_orders FROM expo e JOIN tx t ON e.golden_customer_id=t.golden_customer_id AND transaction_date<campaign_date GROUP BY 1",
    "pen": "SELECT category, count(DISTINCT golden_customer_id) customers, count(DISTINCT golden_customer_id)/(SELECT count(DISTINCT golden_customer_id) FROM tx)::DOUBLE penetration FROM tx GROUP BY 1",
    "cm0": f"SELECT category, count(DISTINCT order_id) orders, {cents('sum(net_sales)')} sales, {cents('sum(gross_margin)')} margin FROM tx GROUP BY 1",
    "cm1": "SELECT *, margin/nullif(orders,0) margin_per_order, margin/nullif(sales,0) margin_rate FROM cm0",
    "cmar": "SELECT *, CASE WHEN max(margin_per_order) OVER ()=min(margin_per_order) OVER () THEN 0.5 ELSE (margin_per_order-min(margin_per_order) OVER ())/nullif(max(margin_per_order) OVER ()-min(margin_per_order) OVER (),0) END margin_score FROM cm1",
    "own": "SELECT DISTINCT golden_customer_id, category FROM tx",
    "adj": "SELECT a.category source_category, b.category candidate_category, count(*) shared_customers, count(*)/any_value(s.n)::DOUBLE adjacency, any_value(s.n) source_customers FROM own a JOIN own b ON a.golden_customer_id=b.golden_customer_id AND a.category<>b.category JOIN (SELECT category, count(*) n FROM own GROUP BY 1) s ON s.category=a.category GROUP BY 1,2",
    "cand": "SELECT c.golden_customer_id, k.category FROM (SELECT DISTINCT golden_customer_id FROM own) c, (SELECT DISTINCT category FROM own) k WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.golden_customer_id=c.golden_customer_id AND o.category=k.category)",
    "sc0": "SELECT c.golden_customer_id, c.category, coalesce(avg(adjacency),0) mean_adjacency, coalesce(max(adjacency),0) max_adjacency FROM cand c JOIN own o ON o.golden_customer_id=c.golden_customer_id LEFT JOIN adj a ON a.source_category=o.category AND a.candidate_category=c.category GROUP BY 1,2",
    "sc1": "SELECT s.*, penetration, margin_score, margin_per_order, 100*(0.5::DOUBLE*mean_adjacency+0.25::DOUBLE*penetration+0.25::DOUBLE*margin_score) category_affinity_score FROM sc0 s JOIN pen USING (category) JOIN cmar USING (category)",
    "sco": "SELECT *, row_number() OVER (PARTITION BY golden_customer_id ORDER BY floor(category_affinity_score*1e6+0.5) DESC, floor(mean_adjacency*1e6+0.5) DESC, floor(margin_per_order*1e4+0.5) DESC, category) category_rank FROM sc1",
    "rec": "SELECT golden_customer_id, max(category) FILTER (category_rank=1) recommended_category, max(category) FILTER (category_rank=2) second_category, max(category) FILTER (category_rank=3) third_category, max(category_affinity_score) FILTER (category_rank=1) category_affinity_score, max(category_affinity_score) FILTER (category_rank=1)-coalesce(max(category_affinity_score) FILTER (category_rank=2),0) affinity_gap FROM sco GROUP BY 1",
    "beh0": f"SELECT golden_customer_id, count(DISTINCT order_id) tx_orders, {cents('sum(net_sales)')} tx_sales, {cents('sum(gross_margin)')} tx_margin, avg(net_sales) tx_aov, avg(CASE WHEN discount_pct>0 THEN 1 ELSE 0 END) discounted_order_share, avg(discount_pct) avg_discount_pct, count(DISTINCT category) categories_used, count(DISTINCT channel) channels_used FROM tx GROUP BY 1",
    "bcat": f"SELECT * FROM (SELECT golden_customer_id, category dominant_category, n, row_number() OVER (PARTITION BY golden_customer_id ORDER BY n DESC, m DESC, category) k FROM (SELECT golden_customer_id, category, count(DISTINCT order_id) n, {cents('sum(gross_margin)')} m FROM tx GROUP BY 1,2)) WHERE k=1",
    "bch": "SELECT * FROM (SELECT golden_customer_id, channel preferred_channel, row_number() OVER (PARTITION BY golden_customer_id ORDER BY n DESC, channel) k FROM (SELECT golden_customer_id, channel, count(DISTINCT order_id) n FROM tx GROUP BY 1,2)) WHERE k=1",
    "beh": "SELECT b.*, tx_margin/nullif(tx_sales,0) tx_margin_rate, dominant_category, preferred_channel, n/tx_orders::DOUBLE dominant_category_share FROM beh0 b JOIN bcat USING (golden_customer_id) JOIN bch USING (golden_customer_id)",
    "nb0": "SELECT p.* EXCLUDE (golden_customer_id), p.golden_customer_id, b.categories_used, b.dominant_category, b.preferred_channel, least(greatest(coalesce(tx_margin_rate, trailing_12m_margin/nullif(trailing_12m_sales,0), 0.30),0.1),0.6) observed_margin_rate, coalesce(dominant_category_share,1) dshare, least(greatest(0.7::DOUBLE*coalesce(discounted_order_share,0)+0.3::DOUBLE*least(greatest(coalesce(avg_discount_pct,0)/0.25::DOUBLE,0),1),0),1) promo, least(greatest(0.6::DOUBLE*lapse_score/100+0.4::DOUBLE*momentum_score/100,0),1) risk, CASE WHEN trailing_12m_sales>0 THEN trailing_12m_sales ELSE coalesce(tx_aov,0) END base_sales, value_score/100 v, customer_value_tier IN ('High','Very High') hv, customer_value_tier IN ('Medium','High','Very High') mv, lifecycle_status IN ('At Risk','Highly Lapsed') hard, cadence_trend_status IN ('Deteriorating','Strongly Deteriorating') det, orders>=2 rep, rfm_segment='Developing' dev, recommended_category FROM prio p LEFT JOIN beh b ON p.golden_customer_id=b.golden_customer_id LEFT JOIN rec r ON p.golden_customer_id=r.golden_customer_id",
    "nb1": "SELECT *, least(greatest(1-dshare,0),1) head, coalesce(hv AND (hard OR cadence_trend_status='Strongly Deteriorating' OR (det AND risk>=0.55)),false) e_protect FROM nb0",
    "nb2": "SELECT *, coalesce(mv AND rep AND (hard OR (NOT active_customer AND risk>=0.45)) AND NOT e_protect,false) e_reengage, coalesce(active_customer AND risk<0.60 AND (dev OR (customer_value_tier IN ('Low','Medium') AND rep)),false) e_develop, coalesce(active_customer AND risk<0.45 AND mv AND rep AND head>=0.35 AND categories_used BETWEEN 2 AND 4,false) e_cross_sell, coalesce(active_customer AND risk<0.45 AND mv AND promo>=0.55,false) e_promote FROM nb1",
    "nb3": "SELECT *, " + ", ".join(f"{one(f'least(greatest(coalesce(100*({x}),0),0),100)')} s_{n}" for n, x in (("protect", "0.30::DOUBLE*v+0.40::DOUBLE*risk+0.20::DOUBLE*hv::INT+0.10::DOUBLE*det::INT"), ("reengage", "0.45::DOUBLE*risk+0.20::DOUBLE*mv::INT+0.20::DOUBLE*(NOT active_customer)::INT+0.15::DOUBLE*rep::INT"), ("develop", "0.35::DOUBLE*dev::INT+0.25::DOUBLE*active_customer::INT+0.20::DOUBLE*v+0.20::DOUBLE*(1-risk)"), ("cross_sell", "0.20::DOUBLE*active_customer::INT+0.20::DOUBLE*mv::INT+0.30::DOUBLE*head+0.15::DOUBLE*rep::INT+0.15::DOUBLE*(1-dshare)"), ("promote", "0.50::DOUBLE*promo+0.15::DOUBLE*active_customer::INT+0.15::DOUBLE*(1-risk)+0.20::DOUBLE*mv::INT"), ("nothing", "0.50::DOUBLE*(1-risk)+0.25::DOUBLE*(1-v)+0.15::DOUBLE*(orders=0)::INT+0.10::DOUBLE*(NOT (e_protect OR e_reengage OR e_develop OR e_cross_sell OR e_promote))::INT"))) + " FROM nb2",
    "nb4": "SELECT *, " + ", ".join(f"base_sales*{u}::DOUBLE*least(greatest({b}::DOUBLE*(0.6::DOUBLE+0.8::DOUBLE*s_{n}/100){x},0),0.8::DOUBLE)*observed_margin_rate-{c} m_{n}" for n, c, b, u, x in (("protect", 18, 0.30, 0.18, ""), ("reengage", 12, 0.24, 0.16, ""), ("develop", 8, 0.22, 0.14, ""), ("cross_sell", 6, 0.18, 0.12, "*(0.7::DOUBLE+head)"), ("promote", 10, 0.20, 0.10, "*(0.7::DOUBLE+promo)"))) + " FROM nb3",
    "nb5": "SELECT *, " + ", ".join(f"e_{n} AND m_{n}>0 AND s_{n}>={t} ok_{n}" for n, t in (("protect", 55), ("reengage", 50), ("develop", 50), ("cross_sell", 55), ("promote", 55))) + " FROM nb4",
    "nb6": "SELECT *, CASE WHEN ok_protect THEN 'Protect' WHEN ok_reengage THEN 'Re-engage' WHEN ok_develop AND (NOT ok_cross_sell OR s_develop>=s_cross_sell) AND (NOT ok_promote OR s_develop>=s_promote) THEN 'Develop' WHEN ok_cross_sell AND (NOT ok_promote OR s_cross_sell>=s_promote) THEN 'Cross-sell' WHEN ok_promote THEN 'Promote' ELSE 'Do Nothing' END act FROM nb5",
    "nba": "SELECT *, CASE act WHEN 'Protect' THEN s_protect WHEN 'Re-engage' THEN s_reengage WHEN 'Develop' THEN s_develop WHEN 'Cross-sell' THEN s_cross_sell WHEN 'Promote' THEN s_promote ELSE s_nothing END action_score, CASE act WHEN 'Protect' THEN m_protect WHEN 'Re-engage' THEN m_reengage WHEN 'Develop' THEN m_develop WHEN 'Cross-sell' THEN m_cross_sell WHEN 'Promote' THEN m_promote ELSE 0 END action_margin FROM nb6",
    "nbx0": "SELECT *, list_sort(list_filter([" + ", ".join(f"CASE WHEN ok_{n} AND act<>'{a}' THEN {{'s': s_{n}, 'i': {-i}, 'a': '{a}'}} END" for i, (n, a) in enumerate((("protect", "Protect"), ("reengage", "Re-engage"), ("develop", "Develop"), ("cross_sell", "Cross-sell"), ("promote", "Promote")))) + "], lambda x: x IS NOT NULL), 'DESC')[1] alt, list_sort([" + ", ".join(f"{{'v': CAST({v} AS DOUBLE), 'i': {-i}, 'n': '{n}'}}" for i, (n, v) in enumerate((("Customer value", "value_score"), ("Lapse risk", "lapse_score"), ("Momentum risk", "momentum_score"), ("Promotion responsiveness", "promo*100"), ("Category headroom", "head*100")))) + "], 'DESC')[1].n primary_driver FROM nba",
    "nbx1": "SELECT *, coalesce(alt.a, 'Do Nothing') alternative_action, greatest(0, action_score-coalesce(alt.s, CASE WHEN act='Do Nothing' THEN 0 ELSE s_nothing END)) gap_, CASE cadence_confidence WHEN 'High' THEN 1.0 WHEN 'Medium' THEN 0.7 ELSE 0.4 END::DOUBLE evidence, coalesce(dominant_category,'relevant category') cat_, coalesce(preferred_channel,'preferred channel') ch_ FROM nbx0",
    "nbx": f"SELECT *, {one('100*(0.45::DOUBLE*action_score/100+0.3::DOUBLE*gap_/100+0.25::DOUBLE*evidence)')} action_confidence, CASE act WHEN 'Protect' THEN customer_value_tier||' value customer with '||lower(lifecycle_status)||' behaviour and elevated lapse or momentum risk. Retain in person via '||ch_||'.' WHEN 'Re-engage' THEN 'Customer of proven value has lapsed. Re-engage through '||ch_||' with '||cat_||' messages.' WHEN 'Develop' THEN 'Active customer with room to grow. Encourage the next purchase before risk rises.' WHEN 'Cross-sell' THEN 'Active customer centred on '||cat_||'; offer '||coalesce(recommended_category,'a neighbouring category')||'.' WHEN 'Promote' THEN 'Customer answers promotions at a profit. Use a targeted offer via '||ch_||'.' ELSE 'No action pays at present. Keep in standard lifecycle activity and watch for change.' END action_rationale FROM nbx1",
    "ptb": "SELECT e.exposure_id, any_value(e.campaign_date) cd, any_value(e.discount_depth) discount_depth, count(DISTINCT order_id) lifetime_orders, sum(net_sales) lifetime_sales, sum(gross_margin) lifetime_margin, avg(net_sales) average_order_value, avg(discount_pct) average_discount_pct, avg(CASE WHEN discount_pct>0 THEN 1 ELSE 0 END) discounted_order_share, count(DISTINCT category) lifetime_categories, count(DISTINCT channel) lifetime_channels, date_diff('day',max(transaction_date),any_value(e.campaign_date)) days_since_last_purchase, date_diff('day',min(transaction_date),any_value(e.campaign_date)) customer_tenure_days, "
    + ", ".join(f"{x} FILTER (transaction_date>=campaign_date-180) {n}" for n, x in (("orders_prior_180d", "count(DISTINCT order_id)"), ("sales0", "sum(net_sales)"), ("margin0", "sum(gross_margin)"), ("categories_prior_180d", "count(DISTINCT category)"), ("channels_prior_180d", "count(DISTINCT channel)"), ("avg_discount_prior_180d", "avg(discount_pct)"), ("discounted_order_share_prior_180d", "avg(CASE WHEN discount_pct>0 THEN 1 ELSE 0 END)")))
    + ", count(DISTINCT order_id) FILTER (category=offer_category) offer_category_prior_orders, coalesce(sum(net_sales) FILTER (category=offer_category),0) offer_category_prior_sales FROM expo e JOIN tx t ON e.golden_customer_id=t.golden_customer_id AND transaction_date<campaign_date GROUP BY 1",
    "ptf": "SELECT *, coalesce(sales0,0) sales_prior_180d, coalesce(margin0,0) margin_prior_180d, lifetime_margin/nullif(lifetime_sales,0) lifetime_margin_rate, coalesce(margin0,0)/nullif(coalesce(sales0,0),0) recent_margin_rate, offer_category_prior_orders/lifetime_orders::DOUBLE offer_category_order_share, CASE WHEN offer_category_prior_orders>0 THEN 1 ELSE 0 END offer_category_seen_before, lifetime_orders/(greatest(customer_tenure_days,1)/30::DOUBLE) orders_per_30d_tenure, sin(2*pi()*month(cd)/12) campaign_month_sin, cos(2*pi()*month(cd)/12) campaign_month_cos FROM ptb WHERE customer_tenure_days>=90 AND lifetime_orders>=2",
    "idk": f"SELECT *, CAST(person AS VARCHAR)||'-'||CAST(k AS VARCHAR) u FROM (SELECT c_custkey person, unnest(range(1, CASE WHEN {bucket('c_custkey', 'fragments', 100)}<64 THEN 2 WHEN {bucket('c_custkey', 'fragments', 100)}<87 THEN 3 WHEN {bucket('c_custkey', 'fragments', 100)}<96 THEN 4 WHEN {bucket('c_custkey', 'fragments', 100)}<99 THEN 5 ELSE 6 END)) k FROM customer)",
    "sdet": "SELECT golden_customer_id, CASE WHEN commercial_value_score>0 THEN commercial_value_score/100 ELSE 0.005 END score, CASE WHEN active_customer THEN 1 ELSE 0 END label FROM prio",
}

# identity records, their normal forms and blocks
_FIRST, _LAST = choose(FIRST_NAMES, bucket("person", "first", 16)), choose(LAST_NAMES, bucket("person", "last", 16))
_CAPITAL = lambda x: f"upper({x}[1])||substr({x},2)"
_CLEAN = lambda x: f"coalesce(trim(regexp_replace(regexp_replace(lower(trim({x})),'[^a-z0-9\\s]','','g'),'\\s+',' ','g')),'')"
_STREET = "lower(trim(address))"
for _long, _short in STREET_TYPES:
    _STREET = f"regexp_replace({_STREET},'\\b{_long}\\b','{_short}','g')"
_DIGITS = "regexp_replace(phone,'\\D','','g')"
CTES.update({
    "idp": f"SELECT *, CASE WHEN k=1 THEN 0 ELSE {bucket('u', 'noise', 10)} END noise, {_FIRST} f, {_LAST} l, '04'||CAST({bucket('person', 'phone', 10)} AS VARCHAR)||lpad(CAST(person AS VARCHAR),7,'0') p, CAST({bucket('person', 'house', 300)}+1 AS VARCHAR)||' '||{choose(STREETS, bucket('person', 'street', 8))} st FROM idk",
    "idr": f"SELECT printf('IDR_%07d_%02d', person, k) identity_record_id, CASE WHEN noise=1 THEN upper(f[1]) ELSE {_CAPITAL('f')} END first_name, CASE WHEN noise=2 THEN {_CAPITAL('l')}||'e' ELSE {_CAPITAL('l')} END last_name, CASE noise WHEN 3 THEN NULL WHEN 4 THEN upper(e) WHEN 5 THEN replace(e,'@','+shop@') ELSE e END email, CASE noise WHEN 6 THEN NULL WHEN 7 THEN '+61 '||substr(p,2) ELSE p END phone, CASE WHEN noise=8 THEN replace(st,'Street','St') ELSE st END address, CAST(2000+{bucket('person', 'postcode', 800)} AS VARCHAR) postcode FROM (SELECT *, f||'.'||l||CAST(person AS VARCHAR)||'@example.com' e FROM idp)",
    "idn": f"SELECT identity_record_id, {_CLEAN('first_name')} norm_first_name, {_CLEAN('last_name')} norm_last_name, coalesce(regexp_replace(regexp_replace(split_part(lower(email),'@',1),'\\+.*$',''),'\\.','','g')||'@'||split_part(lower(email),'@',2),'') norm_email, coalesce(CASE WHEN {_DIGITS} LIKE '61%' AND length({_DIGITS})>=11 THEN '0'||substr({_DIGITS},3) ELSE {_DIGITS} END,'') norm_phone, {_CLEAN(_STREET)} norm_address, coalesce(regexp_replace(postcode,'\\D','','g'),'') norm_postcode FROM idr",
    "idb": "SELECT identity_record_id, unnest([CASE WHEN norm_postcode<>'' AND norm_first_name<>'' AND norm_last_name<>'' THEN 'NP|'||norm_postcode||'|'||left(norm_first_name,1)||'|'||left(norm_last_name,3) END, CASE WHEN norm_postcode<>'' AND norm_last_name<>'' THEN 'LP|'||norm_postcode||'|'||left(norm_last_name,4) END, CASE WHEN split_part(norm_email,'@',1)<>'' AND split_part(norm_email,'@',2)<>'' THEN 'EM|'||left(split_part(norm_email,'@',1),4)||'|'||split_part(norm_email,'@',2) END, CASE WHEN length(norm_phone)>=8 THEN 'PH|'||right(norm_phone,8) END, CASE WHEN regexp_extract(norm_address,'^[0-9]+')<>'' AND norm_postcode<>'' AND norm_last_name<>'' THEN 'AD|'||regexp_extract(norm_address,'^[0-9]+')||'|'||norm_postcode||'|'||left(norm_last_name,1) END]) key FROM idn",
    "idz": "SELECT key, count(*) n FROM idb WHERE key IS NOT NULL GROUP BY key",
})

# households of two people, and one golden customer for each address and postcode
CTES.update({
    "idhv": f"SELECT printf('IDR_%07d_%02d', person, k) identity_record_id, person, k, {choose(VARIANTS, 'noise')} variant, CASE WHEN noise=8 THEN replace(st,'Street','St') ELSE st END own_address, CAST(2000+{bucket('person', 'postcode', 800)} AS VARCHAR) own_postcode FROM idp",
    "idhp": f"SELECT *, row_number() OVER (ORDER BY md5('pair'||CAST(person AS VARCHAR)), person) r, count(*) OVER () n FROM (SELECT person, min(own_address) a, min(own_postcode) b FROM idhv WHERE variant='Canonical' AND {bucket('person', 'household', 1000)}<50 GROUP BY person)",
    "idhc": "SELECT y.person, (y.r+1)//2 c, CASE WHEN y.r%2=0 THEN x.a END a, CASE WHEN y.r%2=0 THEN x.b END b FROM idhp y JOIN idhp x ON x.r=y.r-(CASE WHEN y.r%2=0 THEN 1 ELSE 0 END) WHERE y.r<y.n OR y.n%2=0",
    "idhr": "SELECT identity_record_id, v.person, CASE WHEN c IS NOT NULL THEN printf('HH_%07d', c) END household_case_id, variant||CASE WHEN a IS NOT NULL THEN ' | Shared Household' ELSE '' END variant_type, coalesce(a, own_address) address, coalesce(b, own_postcode) postcode FROM idhv v LEFT JOIN idhc h ON h.person=v.person",
    "idhk": f"SELECT *, {_CLEAN(_STREET)}||'|'||postcode golden FROM idhr",
    "idhg": "SELECT golden, sum(c) n, count(*) people, max(c) most, sum(c*(c-1)) own FROM (SELECT golden, person, count(*) c FROM idhk GROUP BY 1,2) GROUP BY golden",
})

# the recommendation on the history up to an earlier day, and what was bought in the 180 days after it
_OLD = ("pen", "cm0", "cm1", "cmar", "own", "adj", "cand", "sc0", "sc1", "sco")
CTES.update({f"old_{n}": re.sub(rf"\b({'|'.join(('tx', *_OLD))})\b(?![.(])", r"old_\1", CTES[n]) for n in _OLD})
CTES.update({
    "old_tx": "SELECT * FROM tx WHERE transaction_date <= DATE '2001-01-31'",
    "later": "SELECT DISTINCT golden_customer_id, category FROM tx WHERE transaction_date > DATE '2001-01-31' AND transaction_date <= DATE '2001-01-31' + 180 EXCEPT SELECT golden_customer_id, category FROM old_own",
    "hits_": "SELECT l.golden_customer_id, min(category_rank) k FROM later l JOIN old_sco s ON s.golden_customer_id=l.golden_customer_id AND s.category=l.category GROUP BY 1",
})


def with_ctes(select: str) -> str:
    """A statement with exactly the expressions it needs, in order."""
    order: list[str] = []

    def need(sql: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"(?<![\w.'-]){re.escape(name)}(?![\w'])", sql) and CTES[name] != sql:
                if re.search(rf"(?:FROM|JOIN|,)\s+\(?{re.escape(name)}(?![\w'])", sql) or re.search(rf"FROM {re.escape(name)}\b", sql):
                    need(CTES[name])
                    if name not in order:
                        order.append(name)

    need(select)
    body = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    return f"WITH {body}\n{select}" if order else select
