"""Scalar functions: column expressions that stay inside whole-stage code generation."""
