"""Tests of millrace."""
