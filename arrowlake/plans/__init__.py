"""Plan building blocks shared by the operators: reliable checkpoints and iteration."""
