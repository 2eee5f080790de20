"""Column functions: codes, numbers, dates, distances, text and finance."""

from marlstone.functions.codes import canonical_code, commune_code, fold_code, parse_decimal, quarter_label, quarter_start, typology
from marlstone.functions.finance import acquisition_cost, annuity, cash_flow, gross_yield, insurance, net_yield, property_tax
from marlstone.functions.numbers import clip, nearest_even, ratio, rounded, steady_mean, weighted_mean
from marlstone.functions.space import flat_distance2, haversine_km
from marlstone.functions.text import department_hint, list_items, name_key, strip_parenthesis, strip_tags, tag_value

__all__ = [
    "acquisition_cost", "annuity", "canonical_code", "cash_flow", "clip", "commune_code", "department_hint", "flat_distance2", "fold_code", "gross_yield", "haversine_km", "insurance", "list_items",
    "name_key", "nearest_even", "net_yield", "parse_decimal", "property_tax", "quarter_label", "quarter_start", "ratio", "rounded", "steady_mean", "strip_parenthesis", "strip_tags", "tag_value", "typology", "weighted_mean",
]
