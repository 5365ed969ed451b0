"""Schemas as text."""

from strata.plans.schema import schema_from_json, schema_from_simple_string, schema_to_json, schema_to_pretty_json, schema_to_simple_string

__all__ = ["schema_from_json", "schema_from_simple_string", "schema_to_json", "schema_to_pretty_json", "schema_to_simple_string"]
