"""Value semantics: missing, null and typed scalars as Spark columns."""
