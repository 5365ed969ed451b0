"""Nested fields: projection, editing, explosion, schemas."""

from strata.operators.projection import fields, print_schema, schema_string, select, unnest_all_fields, unnest_field, with_fields

__all__ = ["fields", "print_schema", "schema_string", "select", "unnest_all_fields", "unnest_field", "with_fields"]
