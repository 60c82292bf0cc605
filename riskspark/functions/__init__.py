from .expressions import (
    argmax_class,
    case_map,
    class_label,
    clean,
    clean_number,
    compute_once,
    confidence,
    display_name,
    entity_name,
    half_up,
    hash_order_key,
    ordinal_code,
    pearson,
    q,
    risk_band,
    round_percent,
    stack,
    text,
    weighted_total,
)

__all__ = [
    "argmax_class", "case_map", "class_label", "clean", "clean_number", "compute_once", "confidence", "display_name",
    "entity_name", "half_up", "hash_order_key", "ordinal_code", "pearson", "q", "risk_band",
    "round_percent", "stack", "text", "weighted_total",
]
