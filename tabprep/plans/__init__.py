"""Composed plans (cleaning, features) and the registered queries."""
