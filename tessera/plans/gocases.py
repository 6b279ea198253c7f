"""Authored Go code for each rule: code that it finds (+, with the lines of the findings, 1 where none are given) and code that it leaves alone (-).

A line is ``sign lines [imports] (parameters) code``; code behind ``top:`` stands outside of a function, and ⏎ begins a new line.
"""

from __future__ import annotations

from dataclasses import dataclass

TEXT = r"""
@duplicate-condition
+ (a int) if a > 1 { g() } else if a < 0 { h() } else if a > 1 { g() }
+2 (a, b bool) if a && b { g() } else if b { h() } else if⏎a && b { h() }
- (a int) if a > 1 { g() } else if a > 2 { h() }
- (a int) if ok(a) { g() } else if ok(a) { h() }
- (a int) if b := a; b > 1 { g() } else if b > 1 { h() }
@identical-branches
+ (a bool) if a { g(1) } else { g( 1 ) }
- (a bool) if a { g(1) } else { g(2) }
- (a bool) if a { g(1) } else { /* on purpose */ g(1) }
- (a, b bool) if a { g(1) } else if b { g(1) }
@redundant-else
+ (a bool) if a { return } else { g() }
+1,1 (a, b bool) for { if a { if b { break } else { continue } } else { g() } }
- (a bool) if a { panic("x") } else { g() }
- if a := g(); a { return } else { h(a) }
- (a, b bool) if a { return } else if b { g() }
@empty-branch
+ (a bool) if a { }
+ (a bool) if a { g() } else { ; }
- (a bool) if a { /* nothing to do */ }
- (a bool) if a { g() }
@busy-select-loop
+ (c chan int) for { select { case <-c: g(); default: } }
- (c chan int) for { select { case <-c: g(); default: g() } }
- (c chan int, a bool) for a { select { case <-c: g(); default: } }
@ineffective-break
+ (a int) for { switch a { case 1: g(); break } }
+1,1 (c chan int, a bool) for range 3 { select { case <-c: if a { break } else { g(); break } } }
- (a int) L: for { switch a { case 1: break L } }
- (a any) for { switch a.(type) { case int: break } }
- (a int) switch a { case 1: break }
@defer-in-loop
+ (a []int) for range a { defer g() }
+ for i := 0; i < 3; i++ { if i > 1 { defer g() } }
- for { defer g() }
- (a []int) for range a { func() { defer g() }() }
@excessive-nesting
+ top:func f(a bool) { if a { if a { if a { if a { if a { if a { g() } } } } } } }
+ top:func f(a bool) { for { switch { case a: select { default: { if a { for range 3 { g() } } } } } } }
- top:func f(a bool) { if a { if a { if a { if a { if a { g() } } } } } }
- top:func f(a bool) { if a { g() } else if a { g() } else if a { g() } else if a { g() } else if a { g() } else if a { g() } }
@too-many-parameters
+ top:func f(a, b, c, d, e, g, h, i int) {}
+ top:var x func(int, int, int, int, int, int, int, string)
- top:func f(a, b, c, d, e, g, h int) {}
@too-many-results
+ top:func f() (int, int, string, error) { return 0, 0, "", nil }
- top:func f() (a, b int, err error) { return }
@exported-api-documentation
+ top:func F() {}
+2 top:// It does nothing.⏎func F() {}
+2,3 top:type t int⏎type T struct {⏎A int⏎}
- top:// F does nothing.⏎func F() {}
- top:func f() {}
- top:// A T is one.⏎type T struct {⏎// A is one.⏎A int⏎B int // of the kind⏎}
@invalid-build-constraint
+ top://go:build linux
+ top:// +build linux
- top://go:generate stringer
- top:// A build of linux.
@invalid-directive
+ top://go:debug x=1
- top://go:noinline⏎func f() {}
@direct-panic
+ panic("x")
- (panic func(string)) panic("x")
@process-exit
+ [os] os.Exit(1)
+ [log] log.Fatalf("%d", 1)
- [log] log.Print("x")
@context-background
+ [context] g(context.Background())
- [context] g(context.TODO())
@context-todo
+ [context] g(context.TODO())
- (context ctx) g(context.TODO())
@deprecated-ioutil
+ [io/ioutil] ioutil.ReadFile("x")
+ [io/ioutil] g(ioutil.Discard)
- [io] io.ReadAll(nil)
@zero-replace-count
+ [strings] g(strings.Replace("a", "b", "c", 0))
+ [bytes] const n = 1 - 1; g(bytes.Replace(a, b, c, n))
- [strings] g(strings.Replace("a", "b", "c", -1))
- [strings] n := 0; g(strings.Replace("a", "b", "c", n))
@zero-regexp-match-limit
+ [regexp] r := regexp.MustCompile("a"); g(r.FindAllString("a", 0))
- [regexp] r := regexp.MustCompile("a"); g(r.FindAllString("a", 1))
@invalid-regexp
+ [regexp] g(regexp.MustCompile("a(b"))
+ [regexp] g(regexp.MustCompile(`a(?=b)`))
+ [regexp] g(regexp.MatchString("a{1001}", "a"))
- [regexp] g(regexp.MustCompile(`^\pL+(?P<x>[[:alpha:]]*)\z`))
- [regexp] (p string) g(regexp.MustCompile(p))
@invalid-strconv-argument
+ [strconv] g(strconv.ParseInt("1", 1, 64))
+1,1 [strconv] g(strconv.FormatFloat(1, 'z', -1, 16))
- [strconv] g(strconv.ParseInt("1", 0, 64))
- [strconv] g(strconv.FormatFloat(1, 'f', -1, 64))
@invalid-random-bound
+ [math/rand] g(rand.Intn(0))
+ [math/rand/v2] g(rand.IntN(1))
- [math/rand] g(rand.Intn(2))
@time-duration-unit
+ [time] time.Sleep(5)
+ [time] g(time.After(-(3)))
- [time] time.Sleep(0)
- [time] time.Sleep(5 * time.Second)
@nil-context
+ [context] g(context.WithCancel(nil))
+2 [context] top:func f(c context.Context, n int) {}⏎func h() { f(nil, 1) }
- [context] g(context.WithCancel(context.Background()))
@uncatchable-signal
+ [os os/signal] (c chan os.Signal) signal.Notify(c, os.Interrupt, os.Kill)
+ [os/signal syscall] signal.Ignore(syscall.SIGSTOP)
- [os os/signal] (c chan os.Signal) signal.Notify(c, os.Interrupt)
@errors-is-arguments
+ [errors io] (err error) g(errors.Is(io.EOF, err))
- [errors io] (err error) g(errors.Is(err, io.EOF))
@errors-as-target
+ [errors] (err error, n int) g(errors.As(err, &n))
+ [errors] (err error, s string) g(errors.As(err, s))
- [errors] (err error) var e *E; g(errors.As(err, &e))
@regexp-compile-in-loop
+ [regexp] (a []string) for _, s := range a { g(regexp.MatchString("x", s)) }
- [regexp] (a []string) for _, s := range a { h(func() { g(regexp.MatchString("x", s)) }) }
- [regexp] (s, p string) for { g(regexp.MatchString(p, s)) }
@non-octal-file-mode
+ [os] g(os.Mkdir("x", 755))
+ [os] g(os.FileMode(644))
- [os] g(os.Mkdir("x", 0755))
- [os] g(os.Mkdir("x", 0o755))
- [os] g(os.Mkdir("x", 800))
@unnecessary-format
+ [fmt] g(fmt.Sprintf("plain"))
- [fmt] g(fmt.Sprintf("100%%"))
- [fmt] g(fmt.Sprintf("%d", 1))
@unnecessary-sprintf
+ [fmt] (s string) g(fmt.Sprintf("%s", s))
- [fmt] (n int) g(fmt.Sprintf("%s", n))
- [fmt] (s string) g(fmt.Sprintf("%q", s))
@inefficient-string-comparison
+ [strings] (a, b string) g(strings.ToLower(a) == strings.ToLower(b))
- [strings] (a, b string) g(strings.ToLower(a) == strings.ToUpper(b))
- [strings] (a string) g(strings.ToLower(a) == strings.ToLower(a))
@blank-error-discard
+ [os] _, _ = os.Open("x")
+ [os] f, _ := os.Open("x"); g(f)
- [bytes] (b *bytes.Buffer) _, _ = b.WriteString("x")
- [os] f, err := os.Open("x"); g(f, err)
@discarded-error
+ [os] os.Remove("x")
+2 top:func f() error { return nil }⏎func h() { f() }
- [fmt] fmt.Println("x")
- [os] g(os.Remove("x"))
@unchecked-writer-error
+ [bufio os] w := bufio.NewWriter(os.Stdout); w.Flush()
+ [bufio os] w := bufio.NewWriter(os.Stdout); defer w.Flush()
- [bufio os] w := bufio.NewWriter(os.Stdout); g(w.Flush())
@deferred-function-not-called
+2 top:func f() func() { return nil }⏎func h() { defer f() }
- top:func f() func() { return nil }⏎func h() { defer f()() }
@deferred-time-since
+ [time] (t time.Time) defer g(time.Since(t))
- [time] (t time.Time) defer func() { g(time.Since(t)) }()
@exec-pipe-run
+ [os/exec] c := exec.Command("x"); p, err := c.StdoutPipe(); g(p, err); g(c.Run())
- [os/exec] c := exec.Command("x"); p, err := c.StdoutPipe(); g(p, err); g(c.Start())
- [os/exec] c := exec.Command("x"); p, err := c.StdoutPipe(); g(p, err); c = exec.Command("y"); g(c.Run())
@deferred-lock
+ [sync] (m *sync.Mutex) m.Lock(); defer m.Lock()
- [sync] (m *sync.Mutex) m.Lock(); defer m.Unlock()
- [sync] (m, o *sync.Mutex) m.Lock(); defer o.Lock()
@append-no-values
+ (a []int) a = append(a)
- (a []int) a = append(a, 1)
@unused-result
+ [fmt] fmt.Sprintf("%d", 1)
+ [errors] errors.New("x")
- [fmt] fmt.Printf("%d", 1)
@ignored-append-result
+ (a []int) _ = append(a, 1)
- (a []int) a = append(a, 1)
@atomic-update-assignment
+ [sync/atomic] (n int32) n = atomic.AddInt32(&n, 1)
+ [sync/atomic] (n *int64) *n = atomic.AddInt64(n, 1)
- [sync/atomic] (n int32) m := atomic.AddInt32(&n, 1); g(m)
@unbuffered-signal-channel
+ [os os/signal] c := make(chan os.Signal); signal.Notify(c, os.Interrupt)
- [os os/signal] c := make(chan os.Signal, 1); signal.Notify(c, os.Interrupt)
@time-layout
+ [time] g(time.Parse("2006-02-01", "x"))
- [time] g(time.Parse("2006-01-02", "x"))
@time-since
+ [time] (t time.Time) g(time.Now().Sub(t))
- [time] (t, u time.Time) g(u.Sub(t))
@time-until
+ [time] (t time.Time) g(t.Sub(time.Now()))
- [time] (t, u time.Time) g(u.Sub(t))
@inefficient-io-string-write
+ [io] (w io.Writer, b []byte) io.WriteString(w, string(b))
- [io] (w io.Writer, s string) io.WriteString(w, s)
@ineffective-url-query-mutation
+ [net/url] (u *url.URL) u.Query().Set("a", "b")
- [net/url] (u *url.URL) q := u.Query(); q.Set("a", "b"); g(q)
@http-canonical-header-key
+ [net/http] (h http.Header) g(h["content-type"])
- [net/http] (h http.Header) g(h["Content-Type"])
- (h map[string]string) g(h["content-type"])
@net-ip-bytes-equal
+ [bytes net] (a, b net.IP) g(bytes.Equal(a, b))
- [bytes net] (a net.IP, b []byte) g(bytes.Equal(a, b))
@non-slice-sort
+ [sort] (m map[string]int) sort.Slice(m, nil)
- [sort] (a []int) sort.Slice(a, nil)
@invalid-unmarshal-target
+ [encoding/json] (b []byte, m map[string]int) g(json.Unmarshal(b, m))
- [encoding/json] (b []byte, m map[string]int) g(json.Unmarshal(b, &m))
- [encoding/json] (b []byte, v any) g(json.Unmarshal(b, v))
@sync-pool-non-pointer
+ [sync] (p *sync.Pool, b []byte) p.Put(b)
- [sync] (p *sync.Pool, b []byte) p.Put(&b)
@context-key
+ [context] (c context.Context) g(context.WithValue(c, "key", 1))
- [context] (c context.Context, k key) g(context.WithValue(c, k, 1))
@unsafe-host-port
+ [fmt net] (h string, p int) g(net.Dial("tcp", fmt.Sprintf("%s:%d", h, p)))
- [net] (h, p string) g(net.Dial("tcp", net.JoinHostPort(h, p)))
@http-response-before-error
+ [net/http] r, err := http.Get("x"); defer r.Body.Close(); if err != nil { g(r) }
- [net/http] r, err := http.Get("x"); if err != nil { return }; defer r.Body.Close()
@defer-before-error-check
+ [os] f, err := os.Open("x"); defer f.Close(); if err != nil { return }
- [os] f, err := os.Open("x"); if err != nil { return }; defer f.Close()
@testing-goroutine-call
+ [testing] (t *testing.T) go func() { t.Fatal("x") }()
- [testing] (t *testing.T) go func() { t.Error("x") }()
@waitgroup-misuse
+ [sync] var w sync.WaitGroup; go func() { w.Add(1); defer w.Done() }(); w.Wait()
+2 [sync] top:var w sync.WaitGroup⏎func h() { w.Add(1) }⏎func f() { go h() }
- [sync] var w sync.WaitGroup; w.Add(1); go func() { defer w.Done() }(); w.Wait()
@invalid-slog-arguments
+ [log/slog] slog.Info("x", "key")
+ [log/slog] slog.Info("x", 1, 2)
- [log/slog] slog.Info("x", "key", 1)
@printf-arguments
+ [fmt] fmt.Printf("%d", "x")
+ [fmt] fmt.Printf("%d %d", 1)
+ [fmt] fmt.Printf("%d", 1, 2)
+ [fmt] fmt.Printf("%y", 1)
+ [fmt] (err error) fmt.Printf("%w", err)
- [fmt] (err error) g(fmt.Errorf("%w %v %5.2f %s", err, 1, 2.0, "x"))
- [fmt] fmt.Printf("%[1]d %[1]x %%", 1)
@bad-bit-mask
+ (a int) g(a&4 == 2)
+ (a int) g(a|1 != 2)
- (a int) g(a&6 == 2)
@impossible-comparison
+ (a uint8) g(a > 255)
+ (a uint) g(0 > a)
- (a int8) g(a > 126)
@contradictory-condition
+ (a int) g(a == 1 && a == 2)
+ (a int) g(a != 1 || (a != 2))
- (a int) g(a == 1 || a == 2)
- g(h() == 1 && h() == 2)
@redundant-bool-comparison
+ (a bool) g(a == true)
+ (a int) g((a > 1) != false)
- (a any) g(a == true)
@nan-comparison
+ [math] (a float64) g(a == math.NaN())
- [math] (a float64) g(math.IsNaN(a))
@nil-function-comparison
+ top:func f() bool { return f == nil }
- (f func()) g(f == nil)
@impossible-interface-nil-comparison
+ (p *int) g(any(p) == nil)
- (p any) g(any(p) == nil)
@redundant-nil-check
+ (a []int) g(a != nil && len(a) > 0)
+ (a map[string]int) g(a == nil || len(a) == 0)
- (a *[3]int) g(a != nil && len(a) > 0)
- (a []int) g(a != nil && len(a) == 0)
@oversized-shift
+ (a int8) g(a << 8)
+ (a uint32) a >>= 40
- (a int8) g(a << 7)
@integer-division-before-conversion
+ (a, b int) g(float64(a / b))
- (a, b float64) g(float64(a / b))
- (a, b int) g(float64(a) / float64(b))
@suspicious-string-conversion
+ (n int) g(string(n))
- (n rune) g(string(n))
- (b []byte) g(string(b))
@unnecessary-conversion
+ (n int) g(int(n))
- (n int32) g(int(n))
@buffer-string-conversion
+ [bytes] (b *bytes.Buffer) g(string(b.Bytes()))
+ [bytes] (b *bytes.Buffer) g([]byte(b.String()))
- [bytes] (b *bytes.Buffer) g(b.String())
@string-range-rune-conversion
+ (s string) for _, r := range []rune(s) { g(r) }
- (s string) for i, r := range []rune(s) { g(i, r) }
@self-assignment
+ (a int) a = a
+ (a, b []int) a[0], b[0] = a[0], b[1]
- (a, b int) a, b = b, a
- (a []int) a[g()] = a[g()]
@almost-swapped
+ (a, b int) a = b; b = a
- (a, b, t int) t = a; a = b; b = t
@manual-min-max
+ (a, b int) if a < b { a = b }
- (a, b float64) if a < b { a = b }
- (a, b int) if a < b { a = b + 1 }
@subsumed-condition
+ (a int) if a > 5 { g() } else if a > 7 { h() }
+ (a int) if a <= 5 { g() } else if 3 == a { h() }
- (a int) if a > 5 { g() } else if a > 3 { h() }
@needless-blank-identifier
+ (a []int) for _ = range a { g() }
+ (a []int) for i, _ := range a { g(i) }
+ (c chan int) _ = <-c
- (a []int) for _, x := range a { g(x) }
- (c chan int) x := <-c; g(x)
@redundant-type-declaration
+ var x int = 1; g(x)
+ [bytes] var b *bytes.Buffer = bytes.NewBuffer(nil); g(b)
- var x int64 = 1; g(x)
@redundant-closure
+2 top:func f(a int) int { return a }⏎var x = func(a int) int { return f(a) }
- top:func f(a int) int { return a }⏎var x = func(a int) int { return f(a + 1) }
@suspicious-range
+3 top:type t struct { a int }⏎func f(x []t) {⏎for _, v := range x { v.a = 1 }⏎}
- top:type t struct { a int }⏎func f(x []t) {⏎for _, v := range x { v.a = 1; g(v) }⏎}
- top:type t struct { a int }⏎func f(x []*t) {⏎for _, v := range x { v.a = 1 }⏎}
@nil-map-write
+ var m map[string]int; m["a"] = 1
- var m map[string]int; m = h(); m["a"] = 1
- m := map[string]int{}; m["a"] = 1
@invalid-binary-write
+ [encoding/binary] (w io.Writer, n int) g(binary.Write(w, binary.LittleEndian, n))
- [encoding/binary] (w io.Writer, n int32) g(binary.Write(w, binary.LittleEndian, n))
@copied-lock
+2 [sync] top:type t struct { m sync.Mutex }⏎func f(a t) {}
+ [sync] (m *sync.Mutex) o := *m; g(&o)
- [sync] (m *sync.Mutex) o := m; g(o)
@loop-capture
+ var i int; for i = range 3 { go func() { g(i) }() }
- for i := range 3 { go func() { g(i) }() }
@standard-method-signature
+2 top:type t int⏎func (t) MarshalJSON() string { return "" }
+2 top:type t int⏎func (t) WriteByte(b byte) {}
- top:type t int⏎func (t) MarshalJSON() ([]byte, error) { return nil, nil }
- top:type t int⏎func (t) Scan(n int) {}
@invalid-struct-tag
+ top:type t struct { A int `json:a` }
+3 top:type t struct {⏎A int `json:"x"`⏎B int `json:"x,omitempty"`⏎}
+ top:type t struct { a int `json:"a"` }
- top:type t struct { A int `json:"a" xml:"b"` }
@inconsistent-receiver-name
+4 top:type t int⏎func (a t) F() {}⏎func (a t) G() {}⏎func (b t) H() {}
- top:type t int⏎func (a t) F() {}⏎func (_ t) G() {}
@mixed-receiver-type
+4 top:type t int⏎func (a *t) F() {}⏎func (a *t) G() {}⏎func (a t) H() {}
+3 top:type t int⏎func (a *t) F() {}⏎func (a t) G() {}
- top:type t int⏎func (a t) F() {}⏎func (a t) G() {}
@ineffective-value-receiver-assignment
+2 top:type t struct { n int }⏎func (a t) F() { a.n = 1 }
- top:type t struct { n int }⏎func (a *t) F() { a.n = 1 }
- top:type t struct { n int }⏎func (a t) F() t { a.n = 1; return a }
@infinite-recursion
+ top:func f(a int) int { return f(a + 1) }
- top:func f(a int) int { if a > 1 { return 1 }; return f(a + 1) }
@unreachable-code
+ top:func f() int { return 1; g() }
+ for { g() }; h()
- for { break }; h()
- (a bool) if a { return }; h()
@defer-in-infinite-loop
+ for { defer g(); h() }
- (a bool) for { defer g(); if a { return } }
@channel-used-after-close
+ c := make(chan int); close(c); c <- 1
- c := make(chan int); close(c); c = make(chan int); c <- 1
@resource-used-after-close
+ [os] f, err := os.Open("x"); g(err); f.Close(); g(f.Read(nil))
- [os] f, err := os.Open("x"); g(err); f.Close(); g(f.Name())
@sql-transaction-used-after-completion
+ [database/sql] (db *sql.DB) t, err := db.Begin(); g(err); g(t); t.Commit(); t.Exec("x")
- [database/sql] (db *sql.DB) t, err := db.Begin(); g(err); t.Exec("x"); t.Commit()
@dangerous-remove-all
+ [os] os.RemoveAll(os.TempDir())
+ [os] d, err := os.UserHomeDir(); g(err); os.RemoveAll(d)
- [os path/filepath] os.RemoveAll(filepath.Join(os.TempDir(), "x"))
@finalizer-captures-object
+ [runtime] p := new(int); runtime.SetFinalizer(p, func(*int) { g(p) })
- [runtime] p := new(int); runtime.SetFinalizer(p, func(q *int) { g(q) })
@typed-nil-error-return
+ top:func f() error { var e *myError; return e }
- top:func f() error { var e *myError; e = h(); return e }
- top:func f() *myError { var e *myError; return e }
@overwritten-error
+ [os] err := os.Remove("a"); err = os.Remove("b"); g(err)
- [os] err := os.Remove("a"); g(err); err = os.Remove("b"); g(err)
@resource-not-closed
+ [os] f, err := os.Open("x"); if err != nil { return }; f.Read(nil)
+ [os] (a bool) f, err := os.Open("x"); if err != nil { return }; if a { return }; f.Close()
- [os] f, err := os.Open("x"); if err != nil { return }; defer f.Close(); f.Read(nil)
- [os] f, err := os.Open("x"); if err != nil { return }; keep(f)
- [os] (a bool) f, err := os.Open("x"); if err != nil { return }; if a { f.Close(); return }; f.Close()
- [os] f, err := os.Open("x"); if err == nil { f.Close() }
@context-cancel-leak
+ [context] (c context.Context, a bool) d, cancel := context.WithCancel(c); if a { return }; g(d); cancel()
+ [context] (c context.Context) d, _ := context.WithCancel(c); g(d)
- [context] (c context.Context) d, cancel := context.WithCancel(c); defer cancel(); g(d)
- [context] (c context.Context) d, cancel := context.WithCancel(c); g(d, cancel)
@sql-transaction-not-completed
+ [database/sql] (db *sql.DB) t, err := db.Begin(); if err != nil { return }; t.Exec("x")
- [database/sql] (db *sql.DB) t, err := db.Begin(); if err != nil { return }; defer t.Rollback(); t.Commit()
@http-response-body-not-closed
+ [net/http] r, err := http.Get("x"); if err != nil { return }; g(r.StatusCode)
- [net/http] r, err := http.Get("x"); if err != nil { return }; defer r.Body.Close(); g(r.StatusCode)
@writer-not-finalized
+ [compress/gzip] (o io.Writer) w := gzip.NewWriter(o); w.Write(nil)
- [compress/gzip] (o io.Writer) w := gzip.NewWriter(o); w.Write(nil); w.Close()
@unchecked-rows-error
+ [database/sql] (db *sql.DB) r, err := db.Query("x"); g(err); for r.Next() { g() }
- [database/sql] (db *sql.DB) r, err := db.Query("x"); g(err); for r.Next() { g() }; g(r.Err())
@unchecked-scanner-error
+ [bufio os] s := bufio.NewScanner(os.Stdin); for s.Scan() { g(s.Text()) }
- [bufio os] s := bufio.NewScanner(os.Stdin); for s.Scan() { g(s.Text()) }; if s.Err() != nil { g() }
@unchecked-csv-writer-error
+ [encoding/csv os] w := csv.NewWriter(os.Stdout); w.Flush()
+ [encoding/csv os] w := csv.NewWriter(os.Stdout); defer w.Flush()
- [encoding/csv os] w := csv.NewWriter(os.Stdout); w.Flush(); g(w.Error())
@lock-not-released
+ [sync] (m *sync.Mutex, a bool) m.Lock(); if a { return }; m.Unlock()
- [sync] (m *sync.Mutex, a bool) m.Lock(); defer m.Unlock(); if a { return }
- [sync] (m *sync.Mutex) m.Lock()
- [sync] (m *sync.Mutex, a bool) m.Lock(); if a { m.Unlock(); return }; m.Unlock()
@lock-held-across-blocking-call
+ [sync time] (m *sync.Mutex) m.Lock(); time.Sleep(time.Second); m.Unlock()
- [sync time] (m *sync.Mutex) m.Lock(); m.Unlock(); time.Sleep(time.Second)
- [sync time] (m *sync.Mutex) m.Lock(); go func() { time.Sleep(time.Second) }(); m.Unlock()
@unlock-without-lock
+ [sync] (m *sync.RWMutex) m.RLock(); m.Unlock()
+ [sync] (m *sync.Mutex) m.Lock(); m.Unlock(); m.Unlock()
- [sync] (m *sync.Mutex) m.Unlock()
- [sync] (m *sync.Mutex) m.Lock(); m.Unlock()
@waitgroup-negative-counter
+ [sync] var w sync.WaitGroup; w.Add(1); w.Done(); w.Done()
- [sync] var w sync.WaitGroup; w.Add(1); w.Done(); w.Wait()
- [sync] var w sync.WaitGroup; g(&w); w.Done()
@http-response-body-used-after-close
+ [io net/http] r, err := http.Get("x"); g(err); r.Body.Close(); g(io.ReadAll(r.Body))
- [io net/http] r, err := http.Get("x"); g(err); g(io.ReadAll(r.Body)); r.Body.Close()
@nilness
+ (p *int) if p == nil { g(*p) }
+ (f func()) if f != nil { g() } else { f() }
- (p *int) if p == nil { p = new(int); g(*p) }
- (p *int) if p != nil { g(*p) }
@nil-error-wrap
+ [fmt] (err error) if err == nil { g(fmt.Errorf("x: %w", err)) }
- [fmt] (err error) if err != nil { g(fmt.Errorf("x: %w", err)) }
@failed-type-assertion-value
+ (x any) if x, ok := x.(int); !ok { g(x) }
- (x any) if x, ok := x.(int); ok { g(x) }
- (x any) if y, ok := x.(int); !ok { g(x, y) }
@overlapping-encoder-slices
+ [encoding/hex] (b []byte) hex.Encode(b, b)
+ [encoding/base64] (b []byte) base64.StdEncoding.Encode(b[:8], b)
- [encoding/hex] (a, b []byte) hex.Encode(a, b)
@impossible-type-assertion
+3 top:type A interface { M() int }⏎type B interface { M() string }⏎func f(a A) { _ = a.(B) }
+4 top:type A interface { M() int }⏎type B interface { M() string }⏎func f(a A) { switch a.(type) {⏎case B: g() } }
- top:type A interface { M() int }⏎type B interface { M() int; N() }⏎func f(a A) { _ = a.(B) }
@shadowed-error
+ top:func f() (err error) { defer func() { err := h(); g() }(); return nil }
+3 [os] top:func f() error {⏎var err error⏎for range 3 { err := os.Remove("x"); if err != nil { break } }⏎return err⏎}
- top:func f() (err error) { defer func() { err = h() }(); return nil }
- [os] top:func f() error {⏎var err error⏎for range 3 { err = os.Remove("x"); if err != nil { break } }⏎return err⏎}
"""
#: Options that rules without a finding of their own by default are run with.
OPTIONS = {"must-use-result": {"functions": ("f", "strings.ToUpper")}, "standard-library-version": {"version": "go1.20"}}


@dataclass(frozen=True)
class Case:
    """``source`` is a whole file; ``lines`` are those of the findings."""

    source: str
    lines: tuple[int, ...]


def file_of(line: str) -> Case:
    sign, _, rest = line.partition(" ")
    imports = ""
    if rest.startswith("["):
        imports, _, rest = rest[1:].partition("] ")
    head = "package p\n\n" + "".join(f'import "{x}"\n' for x in imports.split()) + "\n"
    if rest.startswith("top:"):
        code, before = rest[4:], 0
    else:
        params, code = "()", rest
        if rest.startswith("("):
            depth = 0
            for i, ch in enumerate(rest):
                depth += (ch == "(") - (ch == ")")
                if not depth:
                    params, code = rest[: i + 1], rest[i + 2 :]
                    break
        code, before = f"func f{params} {{\n{code}\n}}", 1
    at = head.count("\n") + before
    wanted = [int(x) for x in sign[1:].split(",")] if len(sign) > 1 else [1]
    return Case(head + code.replace("⏎", "\n") + "\n", tuple(at + x for x in wanted) if sign[0] == "+" else ())


def cases() -> dict[str, list[Case]]:
    out: dict[str, list[Case]] = {}
    for line in TEXT.strip().split("\n"):
        if line[0] == "@":
            own = out.setdefault(line[1:], [])
        else:
            own.append(file_of(line))
    out["must-use-result"] = [file_of("+2,3 [strings] top:func f() int { return 1 }⏎func h() { f() }⏎func k() { strings.ToUpper(x) }"), file_of("- [strings] top:func f() int { return 1 }⏎var x = f()⏎func k() { strings.ToLower(x) }")]
    out["standard-library-version"] = [file_of("+ [slices] g(slices.Contains(a, b))"), file_of("- [errors] g(errors.Join(a, b))")]
    body = "\n".join("\tg()" for _ in range(101))
    out["too-many-lines"] = [Case(f"package p\n\nfunc f() {{\n{body}\n}}\n", (3,)), Case(f"package p\n\nfunc f() {{\n{body[4:]}\n\n// one less\n}}\n", ())]
    return out
