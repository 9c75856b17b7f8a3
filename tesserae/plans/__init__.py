"""Plans of renames and moves: tables that say what would be done, and opt-in application."""
