"""From questions to plans: what is asked, which filters hold, which operation runs, and what is answered."""
