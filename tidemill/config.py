"""Model definitions, validation rules and window settings."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Mapping:
    """How one training column is made: a source field and an encoding."""

    source: str
    kind: str = "numeric"  # numeric | hash_encode | bool_to_int
    modulo: int = 100


@dataclass(frozen=True)
class ModelDefinition:
    """Ordered input columns of a model and where each comes from."""

    name: str
    columns: tuple[str, ...]
    target: str = "label"
    per_record: dict[str, Mapping] = field(default_factory=dict)
    aggregated: dict[str, Mapping] = field(default_factory=dict)
    transforms: dict[str, Mapping] = field(default_factory=dict)
    store_schema: dict[str, tuple[str, ...]] = field(default_factory=dict)
    label_strategy: str = "rule_based"
    label_threshold: float = 0.65

    def mapping_for(self, column: str) -> Mapping | None:
        """Explicit mappings win over encodings."""
        for table in (self.aggregated, self.per_record, self.transforms):
            if column in table:
                return table[column]
        return None


# The published fraud model definition.
FRAUD_DETECTOR = ModelDefinition(
    name="fraud_detector",
    columns=(
        "hour_of_day",
        "day_of_week",
        "is_weekend",
        "transaction_count_24h",
        "avg_amount_30d",
        "amount",
        "merchant_category_encoded",
        "payment_method_encoded",
    ),
    target="label",
    per_record={
        "hour_of_day": Mapping("hour_of_day"),
        "day_of_week": Mapping("day_of_week"),
        "amount": Mapping("amount"),
    },
    aggregated={
        "transaction_count_24h": Mapping("record_count"),
        "avg_amount_30d": Mapping("avg_amount"),
    },
    transforms={
        "is_weekend": Mapping("is_weekend", "bool_to_int"),
        "merchant_category_encoded": Mapping("merchant_category", "hash_encode", 100),
        "payment_method_encoded": Mapping("payment_method", "hash_encode", 10),
    },
    store_schema={
        "transaction_features": (
            "hour_of_day",
            "day_of_week",
            "is_weekend",
            "amount",
            "merchant_category",
            "payment_method",
        ),
        "aggregated_features": ("record_count", "avg_amount"),
    },
)

MODELS = {FRAUD_DETECTOR.name: FRAUD_DETECTOR}


@dataclass(frozen=True)
class ValidationRules:
    """Required fields, inclusive numeric ranges and allowed categories."""

    required: tuple[str, ...] = ()
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    categories: dict[str, tuple[str, ...]] = field(default_factory=dict)


# The two published rule presets.
RULE_PRESETS = {
    "cloud": ValidationRules(
        required=("user_id", "amount", "timestamp"),
        ranges={"amount": (0, 100000), "risk_score": (0, 1)},
    ),
    "local": ValidationRules(
        required=("user_id", "amount"),
        ranges={"amount": (0, 10000)},
    ),
}

# Highest share of missing values per environment.
MAX_MISSING_RATE = {"default": 0.1, "development": 0.2, "production": 0.05}


@dataclass(frozen=True)
class WindowSpec:
    """Event-time grouping: ``fixed``, ``sliding``, ``session`` or ``none``."""

    kind: str = "fixed"
    size: str = "60 seconds"
    slide: str = "30 seconds"
    gap: str = "600 seconds"
    lateness: str = "5 minutes"


def _mapping(entry, kind: str = "numeric") -> Mapping:
    """A mapping from a bare source field or from its settings."""
    if isinstance(entry, str):
        return Mapping(entry, kind)
    return Mapping(entry["source_field"], entry.get("type", kind), int(entry.get("modulo", 100)))


def model_definition(settings: dict) -> ModelDefinition:
    """A model from the settings of a definition file; unnamed parts stay empty."""
    features, store = settings["features"], settings.get("feature_store") or {}
    mapping, labeling = settings.get("beam_mapping") or {}, store.get("labeling") or {}

    def table(name: str) -> dict[str, Mapping]:
        return {column: _mapping(entry) for column, entry in (mapping.get(name) or {}).items()}

    return ModelDefinition(
        name=settings["model_name"],
        columns=tuple(features["columns"]),
        target=features.get("target", "label"),
        per_record=table("per_record_fields"),
        aggregated=table("aggregated_fields"),
        transforms=table("transforms"),
        store_schema={group: tuple(names) for group, names in (store.get("schema") or {}).items()},
        label_strategy=labeling.get("strategy", "rule_based"),
        label_threshold=float(labeling.get("threshold", 0.65)),
    )


def read_models(spark, path: str) -> dict[str, ModelDefinition]:
    """All models that the JSON or YAML files of a folder define, by name.

    Files are read by Spark, so the folder may be in any store it reaches.
    """
    import json

    found = {}
    for row in spark.read.text(path, wholetext=True).selectExpr("value", "_metadata.file_name AS file").collect():
        if row["file"].endswith((".yaml", ".yml")):
            import yaml

            settings = yaml.safe_load(row["value"])
        else:
            settings = json.loads(row["value"])
        model = model_definition(settings)
        found[model.name] = model
    return found
