class DataQualityError(ValueError):
    """Input tables break a contract an operator relies on."""
