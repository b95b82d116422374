"""Decision rules and explanations as Column expressions.

All of it is per-row projection: the same functions serve a batch ``select`` and a
Structured Streaming ``select`` (see ``creditspark.streaming``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditspark.operators.sweep import round_money

# Decision and impact labels of the decision API.
APPROVED = "APROBADO"
REJECTED = "RECHAZADO"
FAVORABLE = "FAVORABLE"
UNFAVORABLE = "DESFAVORABLE"
NEUTRAL = "NEUTRO"

# Factor names of the six-factor explanation.
F_DTI = "Debt to Income (DTI)"
F_DELINQ = "Historial de Morosidades"
F_UTIL = "Uso de Líneas Rotativas"
F_LTI = "Relación Monto / Ingreso Mensual"
F_SPREAD = "Spread Financiero Neto"
F_EV = "Valor Esperado (EV)"

# Factor names of the four-factor cockpit explanation.
S_DTI = "Debt-to-Income (DTI)"
S_UTIL = "Utilización Rotativa"
S_DELINQ = "Moras Históricas"
S_LTI = "Capacidad de Pago (Monto / Ingreso)"

# PD risk bands (percent): [0, 5), [5, 15), [15, 30), [30, 60], above the gauge.
RISK_BANDS = [(5.0, "low"), (15.0, "moderate"), (30.0, "high"), (60.0, "very_high")]

# Income segmentation of the fairness audit.
LOW_INCOME_LIMIT = 2500.0
LOW_INCOME = "Bajo Ingreso"
MID_HIGH_INCOME = "Medio/Alto Ingreso"


def approve(pd: Column, ev: Column, breakeven: Column, threshold: Column | None = None) -> Column:
    """With a cutoff, ``pd <= cutoff``; otherwise ``ev > 0 and pd <= breakeven``."""
    economic = (ev > 0) & (pd <= breakeven)
    if threshold is None:
        return F.coalesce(economic, F.lit(False))
    return F.coalesce(F.when(threshold.isNotNull(), pd <= threshold).otherwise(economic), F.lit(False))


def effective_threshold(breakeven: Column, threshold: Column | None = None) -> Column:
    return breakeven if threshold is None else F.coalesce(threshold, breakeven)


def decision_label(approved: Column) -> Column:
    return F.when(approved, F.lit(APPROVED)).otherwise(F.lit(REJECTED))


def approve_positive_ev(ev: Column) -> Column:
    """The cockpit rule, ``ev > 0``."""
    return F.coalesce(ev > 0, F.lit(False))


def _pct(x: Column, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f%%", x * F.lit(100.0))


def _factor(name: str, value: Column, impact: Column, description: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"),
                    impact.alias("impact"), description.alias("description"))


def _band3(x: Column, fav: Column, unfav: Column) -> Column:
    return F.when(fav, F.lit(FAVORABLE)).when(unfav, F.lit(UNFAVORABLE)).otherwise(F.lit(NEUTRAL))


def decision_factors(dti: Column, delinq: Column, util: Column, amount: Column, income: Column,
                     rate: Column, cof: Column, pd: Column, ev: Column, breakeven: Column,
                     with_text: bool = True) -> Column:
    """Six explanation factors, ``array<struct<name, value, impact, description>>``.

    ``with_text=False`` leaves ``description`` null (skips the string formatting).
    """
    lti = F.try_divide(amount, income)
    spread = rate - cof
    dti_impact = _band3(dti, dti <= 0.30, dti > 0.45)
    util_impact = _band3(util, util <= 0.30, util > 0.60)
    lti_impact = _band3(lti, lti <= 3.0, lti > 6.0)
    spread_impact = _band3(spread, spread >= 0.08, spread <= 0.0)
    ev_fav = ev > 0
    # Description templates (Spanish, as the decision API returns them).
    dti_text = F.when(dti <= 0.30, F.format_string("DTI saludable (%s), amplia capacidad de servicio de deuda.", _pct(dti))) \
        .when(dti > 0.45, F.format_string("DTI elevado (%s), alto compromiso sobre ingresos disponibles.", _pct(dti))) \
        .otherwise(F.format_string("DTI moderado (%s) dentro de rangos aceptables.", _pct(dti)))
    delinq_text = F.when(delinq == 0, F.lit("Sin morosidades históricas de 30+ días registradas.")) \
        .otherwise(F.format_string("%d eventos de morosidad previa registrados.", delinq.cast("bigint")))
    util_text = F.when(util <= 0.30, F.format_string("Uso prudente de líneas rotativas (%s).", _pct(util))) \
        .when(util > 0.60, F.format_string("Uso intensivo de líneas rotativas (%s), señal de apalancamiento.", _pct(util))) \
        .otherwise(F.format_string("Uso moderado de líneas rotativas (%s).", _pct(util)))
    lti_text = F.when(lti <= 3.0, F.format_string("Monto solicitado representa %.1f meses de ingreso bruto.", lti)) \
        .when(lti > 6.0, F.format_string("Monto solicitado elevado (%.1fx ingreso mensual).", lti)) \
        .otherwise(F.format_string("Monto equivalente a %.1f meses de ingreso bruto.", lti))
    spread_text = F.when(spread >= 0.08, F.format_string("Spread financiero positivo y atractivo (%s).", _pct(spread))) \
        .when(spread <= 0.0, F.format_string("Margen financiero nulo o negativo (%s).", _pct(spread))) \
        .otherwise(F.format_string("Spread financiero estándar (%s).", _pct(spread)))
    ev_text = F.when(ev_fav, F.format_string(
        "Retorno esperado positivo (+$%,.2f USD). PD calibrada (%s) inferior a breakeven (%s).",
        ev, _pct(pd, 2), _pct(breakeven, 2))).otherwise(F.format_string(
            "Riesgo de pérdida esperada (-$%,.2f USD). PD calibrada (%s) supera breakeven (%s).",
            F.abs(ev), _pct(pd, 2), _pct(breakeven, 2)))
    if not with_text:
        none = F.lit(None).cast("string")
        dti_text = delinq_text = util_text = lti_text = spread_text = ev_text = none
    return F.array(
        _factor(F_DTI, F.bround(dti, 4), dti_impact, dti_text),
        _factor(F_DELINQ, delinq, F.when(delinq == 0, F.lit(FAVORABLE)).otherwise(F.lit(UNFAVORABLE)), delinq_text),
        _factor(F_UTIL, F.bround(util, 4), util_impact, util_text),
        _factor(F_LTI, round_money(lti, 2), lti_impact, lti_text),
        _factor(F_SPREAD, F.bround(spread, 4), spread_impact, spread_text),
        _factor(F_EV, round_money(ev, 2), F.when(ev_fav, F.lit(FAVORABLE)).otherwise(F.lit(UNFAVORABLE)), ev_text),
    )


# Texts of the four-factor explanation, favourable first.
SIMPLE_TEXTS = {
    S_DTI: ("Endeudamiento saludable (<35%)", "Sobreendeudamiento elevado (>35%)"),
    S_UTIL: ("Uso conservador de tarjetas", "Líneas de crédito saturadas"),
    S_DELINQ: ("Historial crediticio limpio", "Antecedentes de morosidad 30+ días"),
    S_LTI: ("Monto acorde a capacidad de ingresos", "Apalancamiento alto respecto a ingreso mensual"),
}


def simple_factors(dti: Column, util: Column, delinq: Column, amount: Column, income: Column) -> Column:
    """The four-factor explanation, ``array<struct<name, value, impact, shown, description>>``
    (different cuts from P16; ``shown`` is the value as the table prints it)."""
    lti = F.try_divide(amount, income)

    def factor(name: str, value: Column, good: Column, shown: Column, neutral: Column | None = None) -> Column:
        fair, poor = (F.lit(t) for t in SIMPLE_TEXTS[name])
        bad = F.lit(UNFAVORABLE) if neutral is None else F.when(neutral, F.lit(NEUTRAL)).otherwise(F.lit(UNFAVORABLE))
        return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"),
                        F.when(good, F.lit(FAVORABLE)).otherwise(bad).alias("impact"),
                        shown.alias("shown"), F.when(good, fair).otherwise(poor).alias("description"))

    return F.array(
        factor(S_DTI, dti, dti < 0.35, _pct(dti)),
        factor(S_UTIL, util, util < 0.30, _pct(util), util < 0.60),
        factor(S_DELINQ, delinq, delinq == 0, F.format_string("%d eventos", delinq.cast("bigint"))),
        factor(S_LTI, lti, lti < 3.5, F.format_string("%.1fx ingresos", lti)),
    )


def risk_band(pd: Column) -> Column:
    """PD band label from the gauge ranges (percent)."""
    pct = pd * F.lit(100.0)
    expr = None
    for upper, label in RISK_BANDS:
        cond = pct < upper if upper < 60.0 else pct <= upper
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.when(pct > 60.0, F.lit("beyond_gauge"))


def ev_decomposition(pd: Column, gain: Column, loss: Column) -> list[Column]:
    """``(1-pd)*gain``, ``-pd*loss`` and their sum."""
    return [
        ((F.lit(1.0) - pd) * gain).alias("expected_gain_component"),
        (-(pd * loss)).alias("expected_loss_component"),
        ((F.lit(1.0) - pd) * gain - pd * loss).alias("expected_value"),
    ]


def income_segment(income: Column) -> Column:
    """``< 2500`` is the low-income (protected) group."""
    return F.when(income < LOW_INCOME_LIMIT, F.lit(LOW_INCOME)).otherwise(F.lit(MID_HIGH_INCOME))


def approved_flag(pd: Column, cutoff: float = 0.18) -> Column:
    """``(pd <= cutoff)`` as an int."""
    return (pd <= F.lit(float(cutoff))).cast("int")
