"""Multi-stage plans for work that depends on arrival order."""
