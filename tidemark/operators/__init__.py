"""Stages. Each constructor checks its settings and returns ``DataFrame -> DataFrame``."""
