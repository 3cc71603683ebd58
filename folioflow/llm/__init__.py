"""Operations that prepare training data. Nothing else in folioflow imports this."""
