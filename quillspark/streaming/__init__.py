"""Collections are immutable batch tables; there is no streaming operator to offer here."""
