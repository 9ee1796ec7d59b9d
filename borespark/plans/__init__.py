"""Workloads and the operator registry."""
