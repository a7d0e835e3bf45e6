"""DataFrame -> DataFrame operators: preprocessing, search, knowledge upkeep, evaluation."""
