"""DataFrame operators; every one takes an optional ``by`` list of tender keys."""
