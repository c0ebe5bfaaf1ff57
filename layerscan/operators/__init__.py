"""DataFrame operators: order and position, paging, search, profiles."""
