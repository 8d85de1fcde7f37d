"""DataFrame -> DataFrame operators; ids are always kept."""
