"""The reference workflows, put together from the operators."""
