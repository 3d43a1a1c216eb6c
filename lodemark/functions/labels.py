"""Labels by rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_move_label(change_pct: Column) -> tuple[Column, Column]:
    """Label and confidence of a percent change. The limits are fixed values: 0.25 %, 0.56 to 0.92, 8 %, 20."""
    label = F.when(change_pct > 0.25, "UP").when(change_pct < -0.25, "DOWN").otherwise("SIDEWAYS")
    return label, F.least(F.lit(0.92), F.lit(0.56) + F.least(F.abs(change_pct), F.lit(8.0)) / 20)


def onchain_impact(amount_usd: Column, is_whale: Column, flow: Column) -> tuple[Column, Column]:
    """Label and confidence of a transfer. 250,000 USD; 0.78 and 0.76."""
    small = (amount_usd < 250000) & ~is_whale
    label = F.when(small, "NEUTRAL").when(flow == "to_exchange", "BEARISH").when(flow == "from_exchange", "BULLISH").otherwise("NEUTRAL")
    return label, F.when(label == "BEARISH", 0.78).when(label == "BULLISH", 0.76).otherwise(0.6)


def outcome(pnl: Column) -> Column:
    return F.when(pnl > 0, "win").when(pnl < 0, "loss").otherwise("flat")


def keyword_label(text: Column, lexicons: dict[str, list[str]], confidences: dict[str, float]) -> tuple[Column, Column]:
    """First label, in the order of ``lexicons``, one of whose words the text holds; else NEUTRAL."""
    low, label = F.lower(text), F.lit(None).cast("string")
    for name, words in reversed(lexicons.items()):
        label = F.when(low.rlike("|".join(words)), name).otherwise(label)
    label = F.coalesce(label, F.lit("NEUTRAL"))
    confidence = F.lit(confidences.get("NEUTRAL", 0.5))
    for name, c in confidences.items():
        confidence = F.when(label == name, c).otherwise(confidence)
    return label, confidence


def risk_level(atr: Column, confidence: Column) -> Column:
    """HIGH above an ATR of 1.8 or below a confidence of 0.55; MEDIUM above 1.2 or below 0.75."""
    return F.when((atr > 1.8) | (confidence < 0.55), "HIGH").when((atr > 1.2) | (confidence < 0.75), "MEDIUM").otherwise("LOW")
