"""Tests of millrace.llm."""
